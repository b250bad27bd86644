"""Column functions for terms: equality of constants and columns over text or native types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ast import Const, OneOf


def as_text(value: str | int) -> str:
    return str(value)


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def equals_constant(column: Column, kind: T.DataType, term: Const | OneOf) -> Column:
    """Text compares as text; a number against a native number compares as a number, so that
    the filter can be pushed into the scan."""
    if isinstance(term, OneOf):
        plain = [as_text(t.value) if not is_number(kind) else t.value for t in term.values]
        if is_number(kind) and not all(isinstance(v, int) for v in plain):
            return column.cast("string").isin([as_text(v) for v in plain])
        return (column if is_number(kind) or isinstance(kind, T.StringType) else column.cast("string")).isin(plain)
    if is_number(kind):
        return column == F.lit(term.value) if isinstance(term.value, int) else column.cast("string") == F.lit(term.value)
    return (column if isinstance(kind, T.StringType) else column.cast("string")) == F.lit(as_text(term.value))


def common_types(frames: list[DataFrame]) -> list[DataFrame]:
    """Frames with equal columns, made equal in type: where types differ, both become text."""
    out = list(frames)
    for name in frames[0].columns:
        kinds = {f.schema[name].dataType for f in frames}
        if len(kinds) > 1:
            out = [f.withColumn(name, F.col(name).cast("string")) if not isinstance(f.schema[name].dataType, T.StringType) else f for f in out]
    return out


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
