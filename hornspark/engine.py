"""The engine: programs and relations in, DataFrames out."""

from __future__ import annotations

import logging
from collections import Counter
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ast import Const, Key, Literal, OneOf, Program, Rule, ShellRule, Var, key_text
from .durable import cut, split
from .operators import relational as R
from .operators.fixpoint import Loop
from .operators.product import Sides
from .parser import parse, parse_literal
from .plans import rewrite
from .plans.analysis import check, dependencies, is_recursive, reachable, strata
from .plans.compile import rule_rows
from .sources.files import directory_relations, read_ntriples, read_tsv
from .sources.shell import rows_of
from .sources.triples import input_rules

GIVEN = "__given"
#: Loops and kept relations that are computed at the same time, at most.
AT_ONCE = 8
log = logging.getLogger(__name__)


class Engine:
    """Evaluates rule programs over registered relations.

    params        values of $1, $2, ... in commands of rules
    allow_shell   run commands that are not just files; off by default
    max_rounds    rounds of a loop after which it is given up, with an error
    doubling      evaluate transitive closures by doubling paths instead of step by step
    reuse         store relations that joins make and several literals read, and deal a relation
                  from outside to all conclusions that only filter it in one scan
    """

    def __init__(self, spark: SparkSession, params: Iterable[str] = (), allow_shell: bool = False, max_rounds: int = 100_000, doubling: bool = True, reuse: bool = True):
        self.spark, self.params, self.allow_shell = spark, list(params), allow_shell
        self.max_rounds, self.doubling, self.reuse = max_rounds, doubling, reuse
        self.program = Program()
        self.given: dict[Key, DataFrame] = {}
        self.columns: dict[Key, list[str]] = {}
        self.functions: dict[Key, tuple[Callable[..., DataFrame], tuple[Key, ...]]] = {}

    # ------------------------------------------------------------------ relations

    def register(self, name: str, rows: DataFrame | Iterable[tuple], arity: int | None = None) -> Engine:
        """Rows from outside.  A relation may have rules too; registering again adds rows."""
        if not isinstance(rows, DataFrame):
            rows = [r if isinstance(r, tuple) else tuple(r) for r in rows]
            arity = len(rows[0]) if arity is None else arity
            rows = self.spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in rows], ", ".join(f"c{i} string" for i in range(arity))) if arity else self.spark.range(min(1, len(rows))).select()
        key, df = (name, len(rows.columns)), R.positional(rows)
        self.columns.setdefault(key, rows.columns)
        self.given[key] = R.union(self.spark, [R.Relation(self.given[key]), R.Relation(df)], key[1]).df if key in self.given else df
        return self

    def register_table(self, name: str, table: str, columns: list[str] | None = None) -> Engine:
        """A table of the session's catalog."""
        df = self.spark.table(table)
        return self.register(name, df.select(*columns) if columns else df)

    def register_tsv(self, name: str, paths: str | list[str], arity: int) -> Engine:
        return self.register(name, read_tsv(self.spark, paths, arity))

    def register_ntriples(self, paths: str | list[str], name: str = "facts") -> Engine:
        return self.register(name, read_ntriples(self.spark, paths))

    def register_directory(self, path: str) -> Engine:
        for name, df in directory_relations(self.spark, path).items():
            self.register(name, df)
        return self

    def register_function(self, name: str, arity: int, function: Callable[..., DataFrame], inputs: Iterable[str] = ()) -> Engine:
        """A relation computed from others: ``function`` takes their DataFrames and returns one
        of ``arity`` columns.  The safe way to what commands are used for."""
        self.functions[(name, arity)] = (function, tuple(self._key_of(i) for i in inputs))
        return self

    def _key_of(self, text: str) -> Key:
        name, slash, arity = text.rpartition("/")
        if not slash:
            raise ValueError(f"inputs are written name/arity: {text}")
        return name, int(arity)

    # ------------------------------------------------------------------ programs

    def add(self, program: str | Program) -> Engine:
        self.program = self.program + (parse(program) if isinstance(program, str) else program)
        return self

    def add_triple_rules(self, store: str = "facts", type_name: str = "rdf:type") -> Engine:
        """Define what the program reads and nobody defines as parts of a triple store."""
        return self.add(input_rules(self.program, {*self.given, *self.functions}, store, type_name))

    def known(self) -> list[Key]:
        return [*self.given, *self.functions]

    def prepare(self, query: str | Literal | None = None) -> Prepared:
        """Resolve, check, rewrite and order the rules that a query needs."""
        if isinstance(query, str) and "(" in query:
            query = parse_literal(query)
        if isinstance(query, Literal):
            answer = Literal("__answer", tuple(query.variables))
            return Prepared(self, self.program + Program([Rule(answer, (query,))]), [answer.key])
        return Prepared(self, self.program, [self.program.resolve(query, self.known())])

    def query(self, query: str | Literal | None = None) -> DataFrame:
        """The rows of a relation (``path`` or ``path/2``, by default the last rule's head), or of
        a literal (``path("a", X)``): the values of its variables."""
        return self.prepare(query).rows()

    def evaluate(self, program: str | Program, facts: dict[str, DataFrame | Iterable[tuple]] | None = None, relations: Iterable[str] | None = None) -> dict[str, DataFrame]:
        """Several relations of a program at once; what they share is computed once."""
        inner = Engine(self.spark, self.params, self.allow_shell, self.max_rounds, self.doubling, self.reuse)
        inner.given, inner.functions = dict(self.given), dict(self.functions)
        inner.program = Program(list(self.program.rules))
        inner.add(program)
        for name, rows in (facts or {}).items():
            inner.register(name, rows)
        wanted = [inner.program.resolve(r, inner.known()) for r in relations] if relations is not None else inner.program.heads()
        prepared = Prepared(inner, inner.program, wanted)
        return {key_text(k): prepared.rows(k) for k in wanted}

    def explain(self, query: str | Literal | None = None, spark_plan: bool = False) -> str:
        prepared = self.prepare(query)
        return prepared.describe() + (prepared.rows()._jdf.queryExecution().toString() if spark_plan else "")

    def to_sql(self, query: str | None = None, **options: bool) -> str:
        """One SQL statement (``options`` as ``sqlgen.to_sql`` takes them).  Registered relations are
        tables of their names and columns."""
        from .sqlgen import to_sql

        return to_sql(self.program, self.program.resolve(query, self.known()), self.columns, **options)


class Prepared:
    """A checked and rewritten program, evaluated stratum by stratum as far as is needed.

    Relations without recursion stay lazy, but for those that are worth keeping (``kept``);
    these and loops are computed when first read, those that do not need each other at a
    time."""

    def __init__(self, engine: Engine, program: Program, wanted: list[Key]):
        self.engine, self.wanted = engine, wanted
        check(program)
        program = rewrite.drop_copies(reachable(program, wanted))
        program = rewrite.bind_arguments(program, {*engine.given, *engine.functions})
        self.program = reachable(program, wanted)
        self.groups = strata(self.program)
        self.needs = dependencies(self.program)
        self.group_of = {k: g for g in self.groups for k in g}
        self.done: dict[Key, R.Relation] = {}
        self.splits: dict[Key, DataFrame] = {}
        uses = Counter(x.key for r in self.program if isinstance(r, Rule) for x in r.body)
        uses += Counter(wanted if len(wanted) > 1 else ())
        self.kept = {k for k, n in uses.items() if engine.reuse and n > 1 and self.has_join(k)}
        self.readers = self.dealt_to() if engine.reuse else {}

    def has_join(self, key: Key) -> bool:
        """Whether rules without recursion join something for this relation: what is only filtered
        is read again as cheaply as it is kept."""
        rules = [r for r in self.program.of(key) if isinstance(r, Rule)]
        return not is_recursive(self.group_of.get(key, [key]), self.needs) and any(len(r.body) > 1 for r in rules)

    def dealt_to(self) -> dict[Key, list[Rule]]:
        """Relations from outside, each with the rules of several conclusions that filter it."""
        found: dict[Key, list[Rule]] = {}
        for key in self.program.heads():
            for r in rewrite.merge_constants([r for r in self.program.of(key) if isinstance(r, Rule) and not r.is_fact]):
                if self.filters(r):
                    found.setdefault(r.body[0].key, []).append(r)
        return {leaf: rules for leaf, rules in found.items() if len({r.head.key for r in rules}) > 1}

    def filters(self, rule: Rule) -> bool:
        """Whether a rule reads some rows of one registered relation, and nothing else."""
        x = rule.body[0]
        return len(rule.body) == 1 and not x.negated and x.key in self.engine.given and not self.program.of(x.key) and any(isinstance(a, (Const, OneOf)) for a in x.args)

    def rows(self, key: Key | None = None) -> DataFrame:
        self.ahead()
        r = self.relation(key or self.wanted[0])
        return r.df if r.unique else r.df.distinct()

    def ahead(self) -> None:
        """Compute what is computed at once, in levels: all of a level at the same time."""
        for level in self.levels():
            todo = [g for g in level if g[0] not in self.done]
            for g in todo:  # what they read is lazy, or of an earlier level
                for k in {x for own in g for x in self.needs.get(own, ())} - set(g):
                    self.relation(k)
            if len(todo) > 1:
                with ThreadPoolExecutor(min(len(todo), AT_ONCE)) as pool:
                    for f in [pool.submit(inheritable_thread_target(self.engine.spark)(self.relation), g[0]) for g in todo]:
                        f.result()
            elif todo:
                self.relation(todo[0][0])

    def levels(self) -> list[list[list[Key]]]:
        """Groups that are computed at once: loops and kept relations, each after what it needs."""
        depth: dict[Key, int] = {}
        out: list[list[list[Key]]] = []
        for g in self.groups:
            below = max((depth.get(x, 0) for k in g for x in self.needs.get(k, ()) if x not in g), default=0)
            at_once = is_recursive(g, self.needs) or g[0] in self.kept
            for k in g:
                depth[k] = below + at_once
            if at_once:
                out.extend([] for _ in range(below + 1 - len(out)))
                out[below].append(g)
        return out

    def relation(self, key: Key) -> R.Relation:
        if key not in self.done:
            group = self.group_of.get(key, [key])
            rules = {k: self.program.of(k) for k in group}
            if not any(rules.values()):
                self.done[key] = self.outside(key)
            elif is_recursive(group, self.needs):
                self.loop(group, rules)
            else:
                found = self.plain(key, rules[key])
                self.done[key] = R.Relation(cut(found.df), found.unique) if key in self.kept else found
        return self.done[key]

    def dealt(self, rule: Rule) -> R.Relation:
        """The rows of its relation that a rule filters, from the one scan for all such rules."""
        leaf = rule.body[0].key
        rules = self.readers[leaf]
        if leaf not in self.splits:
            df = self.relation(leaf).df
            fits = [R.condition(df, r.body[0])[0] for r in rules]
            tags = F.array_compact(F.array(*[F.when(w, F.lit(i)) for i, w in enumerate(fits)]))
            self.splits[leaf] = split(df.select("*", F.explode(tags).alias("tag")), "tag")
        return R.Relation(self.splits[leaf].filter(F.col("tag") == rules.index(rule)).drop("tag"))

    def outside(self, key: Key) -> R.Relation:
        """Rows that are not from rules: registered, computed by a function, or none."""
        base = (key[0].removesuffix(GIVEN), key[1])
        engine, parts = self.engine, []
        if base in engine.given:
            parts.append(R.Relation(engine.given[base]))
        if base in engine.functions:
            function, inputs = engine.functions[base]
            parts.append(R.Relation(R.positional(function(*[self.relation(k).df for k in inputs]))))
        if not parts:
            if not key[0].endswith(GIVEN):
                log.warning("%s has no rules and no rows: it is empty", key_text(key))
            return R.empty(engine.spark, key[1])
        return parts[0] if len(parts) == 1 else R.union(engine.spark, parts, key[1])

    def shell(self, rule: ShellRule) -> R.Relation:
        e = self.engine
        rows = rows_of(e.spark, rule, e.params, e.allow_shell, lambda k: self.relation(k).df, e.program, e.known())
        return R.Relation(R.positional(rows))

    def parts(self, key: Key, rules: list[Rule | ShellRule]) -> list[R.Relation]:
        """What each rule gives by itself, the rows from outside among them."""
        facts = [r for r in rules if isinstance(r, Rule) and r.is_fact]
        out = [R.facts(self.engine.spark, facts)] if facts else []
        if key in self.engine.given or key in self.engine.functions:
            out.append(self.outside(key))
        out += [self.shell(r) for r in rules if isinstance(r, ShellRule)]
        merged = rewrite.merge_constants([r for r in rules if isinstance(r, Rule) and not r.is_fact])
        together: dict[Key, list[Rule]] = {}
        for r in merged:
            if r in self.readers.get(r.body[0].key, ()):
                out.append(rule_rows(r, lambda _, x, r=r: self.dealt(r)))
            elif self.engine.reuse and self.filters(r):
                together.setdefault(r.body[0].key, []).append(r)
            else:
                out.append(rule_rows(r, lambda _, x: self.relation(x.key)))
        for leaf, own in together.items():
            out.append(R.one_scan(self.relation(leaf), own) if len(own) > 1 else rule_rows(own[0], lambda _, x: self.relation(x.key)))
        return out

    def plain(self, key: Key, rules: list[Rule | ShellRule]) -> R.Relation:
        parts = self.parts(key, rules)
        if len(parts) == 1:
            return parts[0]  # bags inside a query are fine; rows() makes it a set
        return R.union(self.engine.spark, parts, key[1])

    def loop(self, group: list[Key], rules: dict[Key, list[Rule | ShellRule]]) -> None:
        inside = set(group)
        exits: dict[Key, R.Relation] = {}
        steps: list[Rule] = []
        for key in group:
            own = rules[key]
            if self.engine.doubling and key not in self.engine.given and len(group) == 1 and all(isinstance(r, Rule) for r in own):
                own = rewrite.as_closure(own, key) or own
            recursive = [r for r in own if isinstance(r, Rule) and any(x.key in inside for x in r.body)]
            parts = self.parts(key, [r for r in own if r not in recursive])
            if parts:
                exits[key] = R.union(self.engine.spark, parts, key[1])
            steps += recursive
        product = rewrite.as_product(steps, group[0]) if len(group) == 1 and exits else None
        sides = Sides(product, lambda x: self.relation(x.key)) if product else None
        if sides is not None and sides.fit(exits[group[0]].df):
            self.done[group[0]] = self.product(group[0], exits, sides)
            return
        found = Loop(self.engine.spark, group, steps, lambda x: self.relation(x.key), self.engine.max_rounds).run(exits)
        self.done.update(found)

    def product(self, key: Key, exits: dict[Key, R.Relation], sides: Sides) -> R.Relation:
        """A loop over the rows that can be read again; the others stay lazy unless they are read
        more than once."""
        rule, extra = sides.loop_rule()
        found = Loop(self.engine.spark, [key], [rule], lambda x: extra.get(x.name) or self.relation(x.key), self.engine.max_rounds).run(exits)
        df = sides.whole(found[key].df)
        readers = sum(x.key == key for r in self.program if isinstance(r, Rule) and r.head.key != key for x in r.body)
        return R.Relation(cut(df) if readers + (key in self.wanted) > 1 else df, True)

    def describe(self) -> str:
        """The strata with their rules, loops marked."""
        out = []
        for g in self.groups:
            if any(self.program.of(k) for k in g):
                out.append(("loop " if is_recursive(g, self.needs) else "plain ") + ", ".join(map(key_text, g)))
                out += [f"    {r}" for k in g for r in self.program.of(k)]
        return "\n".join(out) + "\n"


__all__ = ["Const", "Engine", "Prepared", "Var"]
