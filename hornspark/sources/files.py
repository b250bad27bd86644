"""Files as relations, and relations as files.

Rows of text files are split at tabs and nothing else: no quoting, no escaping, and an empty
field is the empty text.  Missing fields are empty, surplus ones are left out."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import names, positional

#: An N-Triples line: subject, predicate, and all up to the final dot.
TRIPLE = r"^\s*(\S+)\s+(\S+)\s+(.*?)\s*\.\s*$"


def read_tsv(spark: SparkSession, paths: str | list[str], arity: int) -> DataFrame:
    lines = spark.read.text(paths)
    fields = F.split("value", "\t")
    return lines.select(*[F.coalesce(F.get(fields, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names(arity))])


def read_ntriples(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(c0, c1, c2): subject, predicate, object as they are written; other lines are left out."""
    lines = spark.read.text(paths).filter(F.col("value").rlike(TRIPLE) & ~F.col("value").rlike(r"^\s*#"))
    return lines.select(*[F.regexp_extract("value", TRIPLE, i + 1).alias(f"c{i}") for i in range(3)])


def as_lines(df: DataFrame) -> DataFrame:
    """Tab-separated lines; a relation without columns has an empty line for its row."""
    if not df.columns:
        return df.select(F.lit("").alias("value"))
    return df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("value"))


def write_tsv(df: DataFrame, path: str, ordered: bool = True) -> None:
    """Distinct rows, sorted by bytes over all files unless ``ordered`` is false."""
    rows = positional(df).distinct()
    as_lines(rows.orderBy(*rows.columns) if ordered and rows.columns else rows).write.text(path)


def write_ntriples(df: DataFrame, path: str) -> None:
    s, p, o = positional(df).distinct().columns
    positional(df).distinct().select(F.concat(F.concat_ws(" ", s, p, o), F.lit(" ."))).write.text(path)


def sorted_lines(df: DataFrame) -> Iterator[str]:
    """The sorted distinct lines, a partition at a time."""
    rows = positional(df).distinct()
    lines = as_lines(rows.orderBy(*rows.columns) if rows.columns else rows)
    return (r["value"] for r in lines.toLocalIterator())


def directory_relations(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A file for each relation: binary if its name begins with a small letter, else unary.  The
    folder may be in any store that Spark reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    out = {}
    for name in sorted(f.getPath().getName() for f in store.listStatus(folder)):
        relation = name.split(".")[0]
        if relation and (relation[0].isalpha()):
            out[relation] = read_tsv(spark, f"{path.rstrip('/')}/{name}", 2 if relation[0].islower() else 1)
    return out


def split_by_predicate(triples: DataFrame, path: str) -> None:
    """Subject and object of every triple, in a folder for each predicate."""
    t = positional(triples)
    t.select(F.col("c1").alias("predicate"), F.concat_ws("\t", "c0", "c2").alias("value")).write.partitionBy("predicate").text(path)
