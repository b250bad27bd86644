"""A loop whose rule multiplies two sides, without storing the product.

``sg(X, Y) :- up(X, A), sg(A, B), up(Y, B).``: most rows pair two ends of ``up`` that nothing goes
up to.  The loop keeps only rows that it can read again (live ones), those whose values are in the
columns that the rule's literals compare them with.  The other rows follow from these in one more
step, which stays lazy: a join of two tables of the inputs' size gives each row once, so that the
product is neither shuffled for a distinct nor written before the sink.

For that, values of the left side are put into classes that reach the same values of the right
side; a value has one class, and a class holds a value of the right side once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ast import Literal, Rule
from ..durable import cut
from ..functions.terms import all_of
from ..plans.compile import rule_rows
from ..plans.rewrite import Product
from . import relational as R
from .fixpoint import PART_ROWS

#: Values (rows times columns) up to which the right side of the last join is broadcast.
SIDE_VALUES = 1_000_000
#: Rows of one class that one side brings to a task where the right side is not broadcast.
SQUARE_ROWS = 1_500
#: Tasks of the last join, at most.
TASKS = 20_000


def tuple_of(columns: list[str]) -> Column:
    return F.struct(*[F.col(c).alias(f"f{i}") for i, c in enumerate(columns)])


def classes(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of distinct pairs (a, b): each a with its class k, and the pairs (k, b) of the classes.  All of
    a class have the same set of b.  Hashes propose classes and the sets are compared in full."""
    held = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("b")).alias("h"), F.bit_xor(F.xxhash64("b", F.lit(1))).alias("g"))
    held = cut(held)
    told = cut(held.join(held.groupBy("n", "h", "g").agg(F.min("a").alias("k")), ["n", "h", "g"]).select("a", "k", "n"))
    firsts = pairs.withColumnRenamed("a", "k")
    equal = pairs.join(told, "a").join(firsts, ["k", "b"], "left_semi").groupBy("a").agg(F.count(F.lit(1)).alias("m"))
    of = cut(told.join(equal, "a", "left").select("a", F.when(F.col("m") == F.col("n"), F.col("k")).otherwise(F.col("a")).alias("k")))
    return of, cut(of.filter(F.col("a").eqNullSafe(F.col("k"))).join(pairs, "a").select("k", "b"))


class Sides:
    """The two sides of a product, and the values that its literals can read."""

    def __init__(self, product: Product, source: Callable[[Literal], R.Relation]):
        self.product, self.source = product, source
        self.rows = [self.of(side) for side in (product.left, product.right)]
        self.live = {i: R.read(source(x), x).df.select(F.col(R.column(v)).alias("v")).dropna().distinct() for i, (x, v) in product.readers().items()}

    def of(self, side: tuple[Literal, ...]) -> DataFrame:
        """Rows of a side: columns named after variables, first those of the head."""
        p = self.product
        wanted = p.head_of(side) + p.link_of(side)
        rows = rule_rows(Rule(Literal("", tuple(wanted)), side), lambda _, x: self.source(x)).df
        return rows.toDF(*map(R.column, wanted)).dropna(subset=[R.column(v) for v in p.link_of(side)])

    def fit(self, exits: DataFrame) -> bool:
        """Whether all that is compared has one type; else values are compared as texts in the loop."""
        kinds = {f.name: f.dataType for rows in self.rows for f in rows.schema}
        p = self.product
        places = range(len(p.rule.head.args))
        given = [exits.schema[f"c{i}"].dataType for i in places]
        fits = all(kinds[R.column(p.rule.head.args[i])] == given[i] == kinds.get(R.column(p.inner.args[i]), given[i]) for i in places)
        return fits and all(df.schema["v"].dataType == given[i] for i, df in self.live.items())

    def loop_rule(self) -> tuple[Rule, dict[str, R.Relation]]:
        """The rule for rows that can be read again, and the relations it reads besides."""
        p = self.product
        extra = {f"__live{i}": R.Relation(df.toDF("c0"), True) for i, df in self.live.items()}
        # in front: of literals that share as many variables the first is joined first
        return Rule(p.rule.head, (*[Literal(f"__live{i}", (p.rule.head.args[i],)) for i in self.live], *p.rule.body)), extra

    def flagged(self, df: DataFrame, columns: dict[int, str]) -> DataFrame:
        """``df`` with a column that says whether these places can be read again."""
        flags = []
        for i, c in columns.items():
            if i in self.live:
                df = df.join(self.live[i].select(F.col("v").alias(f"live{i}")), F.col(c) == F.col(f"live{i}"), "left")
                flags.append(f"live{i}")
        return df.withColumn("live", all_of([F.col(f).isNotNull() for f in flags])).drop(*flags)

    def factored(self, known: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What follows from the known rows in one step, as two tables: the left side's columns, their
        class k and whether they can be read again, and the same of the right side."""
        p, (left, right) = self.product, self.rows
        places = {v: i for i, v in enumerate(p.inner.args)}
        heads = [[R.column(v) for v in p.head_of(s)] for s in (p.left, p.right)]
        links = [[R.column(v) for v in p.link_of(s)] for s in (p.left, p.right)]
        ends = [tuple_of([f"c{places[v]}" for v in p.link_of(s)]) for s in (p.left, p.right)]
        used = [f"c{places[v]}" for s in (p.left, p.right) for v in p.link_of(s)]
        low, low_sets = classes(cut(known.dropna(subset=used).select(ends[0].alias("a"), ends[1].alias("b")).distinct()))
        met = left.select(tuple_of(heads[0]).alias("x"), tuple_of(links[0]).alias("a")).join(low, "a")
        high, high_sets = classes(cut(met.select(F.col("x").alias("a"), F.col("k").alias("b")).distinct()))
        reach = high_sets.withColumnRenamed("b", "low").join(low_sets.withColumnRenamed("k", "low"), "low").select("k", "b").distinct()
        ours = reach.join(right.select(tuple_of(heads[1]).alias("y"), tuple_of(links[1]).alias("b")), "b").select("k", "y").distinct()
        out = []
        for rows, own, names in ((high, "a", heads[0]), (ours, "y", heads[1])):
            wide = rows.select(*[F.col(f"{own}.f{i}").alias(n) for i, n in enumerate(names)], "k")
            out.append(cut(self.flagged(wide, {i: R.column(v) for i, v in enumerate(p.rule.head.args) if R.column(v) in names})))
        return out[0], out[1]

    def whole(self, known: DataFrame) -> DataFrame:
        """The known rows and, lazily, those that follow from them and cannot be read again."""
        head = [R.column(v) for v in self.product.rule.head.args]
        names = R.names(len(head))
        left, right = self.factored(known)
        right = right.withColumnRenamed("live", "live_too")
        sizes = [df.groupBy("k").agg(F.count(F.lit(1)).cast("double").alias(f"n{i}"), F.count_if(flag).cast("double").alias(f"m{i}")) for i, (df, flag) in enumerate(((left, F.col("live")), (right, F.col("live_too"))))]
        both = sizes[0].join(sizes[1], "k")
        made = both.agg(F.sum(F.expr("n0 * n1 - m0 * m1")), F.sum(F.expr("n0 * n1"))).first()
        if not made[0]:
            return known
        # rows that the loop began with may be no live ones, and follow too
        dead = self.flagged(known, dict(enumerate(names))).filter(~F.col("live")).select(*[F.col(n).alias(h) for n, h in zip(names, head, strict=True)])
        dead = cut(dead)
        if not dead.isEmpty():
            for df in (left, right):
                own = df.toDF(*[f"{c}_" for c in df.columns])
                same = [dead[c].eqNullSafe(own[f"{c}_"]) for c in df.columns if c in dead.columns]
                dead = dead.join(own, all_of(same)).select(*[dead[c] for c in dead.columns if c != "k"], own["k_"].alias("k"))
            known = R.minus(known.toDF(*[f"x{i}" for i in range(len(names))]), dead.select(*head)).toDF(*names)
        return known.union(self.multiplied(left, right, both, made[1]).select(*[F.col(h).alias(n) for h, n in zip(head, names, strict=True)]))

    def multiplied(self, left: DataFrame, right: DataFrame, sizes: DataFrame, rows: float) -> DataFrame:
        """The join of both sides by class, without what the loop holds, in tasks of about
        ``PART_ROWS`` rows each: a class may have any share of them."""
        tasks, on = min(TASKS, int(rows // PART_ROWS) + 1), ["k"]
        if right.count() * len(right.columns) <= SIDE_VALUES:
            right = F.broadcast(right)
            left = left.repartition(tasks) if tasks > 1 else left
        elif tasks > 1:  # a class is cut into squares
            on = ["k", "s0", "s1"]
            cuts = sizes.select("k", F.ceil(F.col("n0") / SQUARE_ROWS).alias("p0"), F.ceil(F.col("n1") / SQUARE_ROWS).alias("p1"))
            left, right = (
                df.join(cuts, "k").select(*df.columns, F.pmod(F.xxhash64(*df.columns), F.col(f"p{own}")).alias(f"s{own}"), F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"p{1 - own}") - 1)).alias(f"s{1 - own}")).repartition(tasks, *on)
                for own, df in enumerate((left, right))
            )
        return left.join(right, on).filter(~(F.col("live") & F.col("live_too")))
