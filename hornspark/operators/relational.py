"""The relational operators.  A relation is a DataFrame with the columns c0, c1, ...; inside a
rule, columns are named after variables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ast import Const, Literal, OneOf, Rule, Var
from ..functions.terms import all_of, as_text, common_types, equals_constant


@dataclass(frozen=True)
class Relation:
    """``unique``: known to hold no row twice, so that no distinct is needed."""

    df: DataFrame
    unique: bool = False


def names(arity: int) -> list[str]:
    return [f"c{i}" for i in range(arity)]


def positional(df: DataFrame) -> DataFrame:
    return df.toDF(*names(len(df.columns)))


def empty(spark: SparkSession, arity: int) -> Relation:
    return Relation(spark.createDataFrame([], T.StructType([T.StructField(n, T.StringType()) for n in names(arity)])), True)


def facts(spark: SparkSession, rules: list[Rule]) -> Relation:
    """All facts of a relation as one local table of texts."""
    rows = list(dict.fromkeys(tuple(as_text(a.value) for a in r.head.args) for r in rules))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names(len(rows[0]))])
    if not rows[0]:
        return Relation(spark.range(1).select(), True)
    return Relation(spark.createDataFrame(rows, schema), True)


def column(v: Var) -> str:
    return f"v_{v.name}"


def condition(df: DataFrame, literal: Literal) -> tuple[Column | None, dict[Var, int]]:
    """What the constants and repeated variables of a literal ask of the rows of ``df`` (None:
    nothing), and the place of each variable."""
    first: dict[Var, int] = {}
    where = []
    for i, a in enumerate(literal.args):
        c = F.col(f"c{i}")
        if isinstance(a, (Const, OneOf)):
            where.append(equals_constant(c, df.schema[f"c{i}"].dataType, a))
        elif a in first:
            kinds = {df.schema[f"c{k}"].dataType for k in (i, first[a])}
            where.append(c == F.col(f"c{first[a]}") if len(kinds) == 1 else c.cast("string") == F.col(f"c{first[a]}").cast("string"))
        else:
            first[a] = i
    return (all_of(where) if where else None), first


def read(relation: Relation, literal: Literal) -> Relation:
    """Filter by the constants and repeated variables of a literal, one column per variable."""
    df = relation.df
    where, first = condition(df, literal)
    if where is not None:
        df = df.filter(where)
    kept = df.select(*[F.col(f"c{i}").alias(column(v)) for v, i in first.items()])
    return Relation(kept, relation.unique and not any(isinstance(a, OneOf) for a in literal.args))


def witness(df: DataFrame) -> DataFrame:
    """One row if ``df`` has any: a relation as a condition."""
    return df.select(F.lit(1).alias("_any")).limit(1)


def comparable(left: DataFrame, right: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Columns of different types compare as texts, unless both are numbers."""
    for c in columns:
        kinds = [d.schema[c].dataType for d in (left, right)]
        if kinds[0] != kinds[1] and not all(isinstance(k, T.NumericType) for k in kinds):
            left, right = (d.withColumn(c, F.col(c).cast("string")) for d in (left, right))
    return left, right


def join(left: DataFrame, right: DataFrame, keep_right: bool) -> DataFrame:
    """Natural join on the common columns; with ``keep_right`` false a semi-join."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        return left.crossJoin(right) if keep_right else left.join(F.broadcast(witness(right)), F.lit(True), "left_semi")
    left, right = comparable(left, right, shared)
    return left.join(right, shared, "inner" if keep_right else "left_semi")


def anti_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` without a partner in ``right`` on the common columns."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        return left.join(F.broadcast(witness(right)), F.lit(True), "left_anti")
    left, right = comparable(left, right.select(*shared), shared)
    return left.join(right, shared, "left_anti")


def project(df: DataFrame, head: Literal) -> DataFrame:
    """The head's columns: variables, repeated ones too, and constants as text."""
    return df.select(*[(F.col(column(a)) if isinstance(a, Var) else F.lit(as_text(a.value))).alias(f"c{i}") for i, a in enumerate(head.args)])


def one_scan(relation: Relation, rules: list[Rule]) -> Relation:
    """Rows of the heads of rules that each read this relation and nothing else: one pass, in
    which a row gives a row for each rule that it fits."""
    df = relation.df
    plans = [(condition(df, r.body[0]), r.head) for r in rules]
    kinds = [[df.schema[f"c{first[a]}"].dataType if isinstance(a, Var) else T.StringType() for a in head.args] for (_, first), head in plans]
    same = [len(set(k)) == 1 for k in zip(*kinds, strict=True)]
    out = []
    for (where, first), head in plans:
        values = [F.col(f"c{first[a]}") if isinstance(a, Var) else F.lit(as_text(a.value)) for a in head.args]
        row = F.struct(*[(v if s else v.cast("string")).alias(f"c{i}") for i, (v, s) in enumerate(zip(values, same, strict=True))])
        out.append(row if where is None else F.when(where, row))
    wheres = [where for (where, _), _ in plans]
    if all(w is not None for w in wheres):
        fits = wheres[0]
        for w in wheres[1:]:
            fits = fits | w
        df = df.filter(fits)
    rows = df.select(F.explode(F.array_compact(F.array(*out))).alias("r"))
    return Relation(rows.select(*[F.col(f"r.{n}").alias(n) for n in names(len(rules[0].head.args))]))


def union(spark: SparkSession, parts: list[Relation], arity: int) -> Relation:
    """Set union."""
    if not parts:
        return empty(spark, arity)
    if len(parts) == 1:
        return parts[0] if parts[0].unique else Relation(parts[0].df.distinct(), True)
    frames = common_types([p.df for p in parts])
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return Relation(out.distinct(), True)


def same_row(left: DataFrame, right: DataFrame) -> Column:
    """All columns equal by place; nulls equal nulls, or a loop would never end."""
    return all_of([left[a].eqNullSafe(right[b]) for a, b in zip(left.columns, right.columns, strict=True)])


def common(df: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of ``df`` that ``other`` holds too; the columns' names must differ."""
    return df.join(other, same_row(df, other), "left_semi")


def minus(new: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of ``new`` not in ``known``."""
    if not new.columns:
        return new.join(F.broadcast(witness(known)), F.lit(True), "left_anti")
    right = known.toDF(*[f"k{i}" for i in range(len(known.columns))])
    return new.join(right, same_row(new, right), "left_anti")
