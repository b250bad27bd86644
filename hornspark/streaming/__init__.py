"""Programs over streams.

Rules without recursion and negation only ever add rows when their inputs grow, so they run
as Structured Streaming plans.  For the others ``maintain`` evaluates a program again on
all rows so far whenever a batch arrives, and hands over what was not there before."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from ..ast import Program, Rule
from ..durable import shared_folder
from ..engine import Engine
from ..operators import relational as R
from ..parser import parse
from ..plans.analysis import check, dependencies, is_recursive, reachable, strata
from ..plans.compile import rule_rows


class NotMonotone(ValueError):
    """The rules cannot run as one streaming plan."""


def streaming_rows(program: str | Program, relation: str, inputs: dict[str, DataFrame]) -> DataFrame:
    """A streaming DataFrame of one relation: joins, constants and unions over ``inputs``, of
    which some are streams.  Rows may repeat, as a stream has no end to remove them at."""
    program = parse(program) if isinstance(program, str) else program
    check(program)
    key = program.resolve(relation)
    program = reachable(program, [key])
    needs = dependencies(program)
    given = {(n, len(df.columns)): R.Relation(R.positional(df)) for n, df in inputs.items()}
    for group in strata(program):
        rules = program.of(group[0])
        if is_recursive(group, needs) or any(not isinstance(r, Rule) or r.negative for r in rules):
            raise NotMonotone("recursion, negation and commands need maintain()")
        parts = [rule_rows(r, lambda _, x: given[x.key]) for r in rules if not r.is_fact]
        if any(r.is_fact for r in rules):
            parts.append(R.facts(next(iter(inputs.values())).sparkSession, [r for r in rules if r.is_fact]))
        if group[0] in given:
            parts.append(given[group[0]])
        df = parts[0].df if parts else None
        for p in parts[1:]:
            df = df.union(p.df)
        if df is not None:
            given[group[0]] = R.Relation(df)
    return given[key].df


def maintain(engine: Engine, relation: str, stream: DataFrame, name: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Keep ``relation`` up to date while ``stream`` adds rows to the input relation ``name``.

    Every batch is appended to a table in the shared folder, the relation is evaluated, and
    ``sink`` gets the rows that are new, with the batch's number.  Relations that shrink
    (negation) only report what is added.  A batch that runs again replaces itself."""
    folder = f"{shared_folder(engine.spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = R.positional(stream).schema
    spark = engine.spark

    def each(batch: DataFrame, number: int) -> None:
        R.positional(batch).write.mode("overwrite").parquet(f"{folder}/in/batch={number}")
        arrived = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        current = Engine(spark, engine.params, engine.allow_shell, engine.max_rounds, engine.doubling)
        current.program, current.given, current.functions = engine.program, dict(engine.given), dict(engine.functions)
        rows = current.register(name, arrived).query(relation)
        rows.write.mode("overwrite").parquet(f"{folder}/out/{number}")
        rows = spark.read.schema(rows.schema).parquet(f"{folder}/out/{number}")
        if number:
            before = spark.read.schema(rows.schema).parquet(f"{folder}/out/{number - 1}")
            sink(R.minus(rows, before), number)
        else:
            sink(rows, number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/offsets").start()
