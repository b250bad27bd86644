"""The least fixpoint of a strongly connected component, semi-naively.

A round joins what was new in the last round (the delta) with all that is known, keeps what
is not known yet, and writes it to the shared folder: lineage does not grow, and a lost
executor costs nothing.  All relations of a component go round in one tagged table, so that
a round is one job however many relations there are.  Inputs from outside the loop are
persisted for its time, and a delta that is known to be small is broadcast.  Counting a delta
also tells which literals of the rules fit any of its rows; a rule takes part in a round only
if the literal that reads the delta does, and the others fit something known.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ast import Key, Literal, Rule, Var, key_text
from ..durable import cut
from ..functions.terms import common_types
from ..plans.compile import rule_rows
from . import relational as R

log = logging.getLogger(__name__)

#: Values (rows times columns) up to which a delta is broadcast.
BROADCAST_VALUES = 200_000
#: Parts that the known rows may be in, and rows of a partition when parts are merged.
PARTS, PART_ROWS = 8, 2_000_000
#: Known rows up to which a round's rules share as many tasks as there are cores.
SMALL_ROWS = 1_000_000
#: Known rows from which on a round looks at how much it derived before it compares.
LARGE_ROWS = 5_000_000


class IterationLimit(RuntimeError):
    """The loop did not end in the rounds allowed; there is no partial result."""


def together(frames: list[DataFrame]) -> DataFrame:
    frames = common_types(frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def tagged(spark: SparkSession, rows: dict[Key, R.Relation], group: list[Key]) -> DataFrame:
    """One table of several relations: tag, then the columns, null where a relation is narrower."""
    width = max(k[1] for k in group)
    parts = []
    for tag, key in enumerate(group):
        if key in rows:
            df = rows[key].df
            parts.append(df.select(F.lit(tag).alias("tag"), *[F.col(f"c{i}") if i < key[1] else F.lit(None).cast("string").alias(f"c{i}") for i in range(width)]))
    return together(parts)


def of_tag(df: DataFrame, tag: int, arity: int) -> DataFrame:
    return df.filter(F.col("tag") == tag).select(*R.names(arity))


class Loop:
    def __init__(self, spark: SparkSession, group: list[Key], rules: list[Rule], outside: Callable[[Literal], R.Relation], max_rounds: int):
        self.spark, self.group, self.max_rounds = spark, group, max_rounds
        self.members, self.rules, self.outside = set(group), rules, outside
        self.kept: dict[str, R.Relation] = {}
        self.inner = list(dict.fromkeys(shape(x) for r in rules for x in r.body if x.key in self.members))

    def source(self, literal: Literal) -> R.Relation:
        """A relation from outside, held in memory (or on disk) while the loop runs."""
        text = f"{literal.name}/{len(literal.args)}"
        if text not in self.kept:
            found = self.outside(literal)
            self.kept[text] = R.Relation(found.df.persist(), found.unique)
        return self.kept[text]

    def run(self, exits: dict[Key, R.Relation]) -> dict[Key, R.Relation]:
        try:
            return self._run(exits)
        finally:
            for r in self.kept.values():
                r.df.unpersist()

    def _run(self, exits: dict[Key, R.Relation]) -> dict[Key, R.Relation]:
        start = {k: R.union(self.spark, [exits[k]], k[1]) for k in self.group if k in exits}
        if not start:
            return {k: R.empty(self.spark, k[1]) for k in self.group}
        delta = cut(tagged(self.spark, start, self.group))
        size, now = self.looked_at(delta)
        known, rounds, ever = [(size, delta)], 0, set(now)
        while size:
            rounds += 1
            if rounds > self.max_rounds:
                raise IterationLimit(f"{', '.join(map(key_text, self.group))}: more than {self.max_rounds} rounds")
            total = together([df for _, df in known])
            derived = self.step(delta, total, size, now, ever)
            if derived is None:
                break
            derived, total = common_types([derived, total])
            if sum(n for n, _ in known) <= SMALL_ROWS:  # many rules over few rows would be many empty tasks
                derived = derived.coalesce(self.spark.sparkContext.defaultParallelism)
            delta = self.new_rows(derived, total, sum(n for n, _ in known))
            size, now = self.looked_at(delta)
            ever |= now
            log.info("%s: round %d, %d new rows", ", ".join(map(key_text, self.group)), rounds, size)
            if size:
                known.append((size, delta))
                if len(known) > PARTS:
                    known = self.compacted(known)
        total = together([df for _, df in known])
        return {k: R.Relation(of_tag(total, i, k[1]), True) for i, k in enumerate(self.group)}

    def looked_at(self, delta: DataFrame) -> tuple[int, set[Literal]]:
        """The number of rows, and the literals (by shape) that fit one of them."""
        fits = []
        for x in self.inner:
            where, _ = R.condition(delta, x)
            own = F.col("tag") == self.group.index(x.key)
            fits.append(F.max(own if where is None else own & where))
        found = delta.agg(F.count(F.lit(1)), *fits).first()
        return found[0], {x for x, fit in zip(self.inner, found[1:], strict=True) if fit}

    def new_rows(self, derived: DataFrame, total: DataFrame, known: int) -> DataFrame:
        """What of ``derived`` is not known.  Where much is known and little was derived, the
        derived rows go to the known ones, which then need no shuffle."""
        fresh = derived.toDF(*[f"x{i}" for i in range(len(total.columns))]).distinct()
        if known > LARGE_ROWS:
            fresh = cut(fresh)
            if fresh.count() * len(total.columns) <= BROADCAST_VALUES:
                total = R.common(total, F.broadcast(fresh))
        return cut(R.minus(fresh, total).toDF(*total.columns))

    def compacted(self, known: list[tuple[int, DataFrame]]) -> list[tuple[int, DataFrame]]:
        """The smaller half of the parts written as one, so that parts stay few and a row is
        written again only as often as its part doubles."""
        known = sorted(known, key=lambda p: p[0])
        few, rest = known[: PARTS // 2 + 1], known[PARTS // 2 + 1 :]
        rows = sum(n for n, _ in few)
        parts = max(self.spark.sparkContext.defaultParallelism, -(-rows // PART_ROWS))
        return [(rows, cut(together([df for _, df in few]).coalesce(parts))), *rest]

    def step(self, delta: DataFrame, total: DataFrame, size: int, now: set[Literal], ever: set[Literal]) -> DataFrame | None:
        """All that follows in one round from a new row: for every rule, each literal of the loop
        reads the delta once and the others read all that is known.  ``now`` and ``ever``: the
        literals that fit rows of the delta, and of all that is known."""
        small = size * len(delta.columns) <= BROADCAST_VALUES
        out: dict[Key, list[R.Relation]] = {}
        for rule in self.rules:
            inner = [i for i, x in enumerate(rule.body) if x.key in self.members]
            # every pair of an old and a new row of a closure is also a new and an old one
            if len(inner) == 2 and is_closure_step(rule):
                inner = inner[:1]
            if any(shape(rule.body[i]) not in ever for i in inner):
                continue
            for new in inner:
                if shape(rule.body[new]) not in now:
                    continue

                def source(i: int, x: Literal, new: int = new) -> R.Relation:
                    if x.key not in self.members:
                        return self.source(x)
                    tag = self.group.index(x.key)
                    if i == new:
                        own = of_tag(delta, tag, x.key[1])
                        return R.Relation(F.broadcast(own) if small and len(rule.positive) > 1 else own, True)
                    return R.Relation(of_tag(total, tag, x.key[1]), True)

                out.setdefault(rule.head.key, []).append(rule_rows(rule, source, first=new))
        if not out:
            return None
        rows = {}
        for key, parts in out.items():
            rows[key] = R.Relation(together([p.df for p in parts]))
        return tagged(self.spark, rows, self.group)


def shape(x: Literal) -> Literal:
    """The literal with its variables renamed in order: equal for literals that fit the same rows."""
    names: dict[Var, Var] = {}
    return Literal(x.name, tuple(names.setdefault(a, Var(f"V{len(names)}")) if isinstance(a, Var) else a for a in x.args))


def is_closure_step(rule: Rule) -> bool:
    """``p(X, Z) :- p(X, Y), p(Y, Z).``"""
    if len(rule.body) != 2 or any(x.key != rule.head.key or x.negated for x in rule.body) or rule.head.key[1] != 2:
        return False
    (a, b), (c, d) = rule.body[0].args, rule.body[1].args
    return rule.head.args == (a, d) and b == c and len({a, b, d}) == 3 and all(isinstance(t, Var) for t in (a, b, d))
