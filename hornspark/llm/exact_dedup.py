"""Exact dedup by two-pass Bloom filtering, in DataFrame functions only.

Pass 1 puts every row's hash into ``HASHES`` slots of a filter and keeps the slots that were
hit twice or more, as packed bitmaps.  What it moves is a slot number a hash, combined
before the shuffle; no row and no digest.  Pass 2 tests each row against these bitmaps: a
row with a slot that was hit once is certainly unique and passes straight through; only the
others are grouped by their full SHA-256.  The groups that hold a thousandth of all rows or
more (at most 1000 groups) go to the rows by broadcast.

The filter has ``bits_per_row`` bits a row at every size.  One of at most ``max_filter_bytes``
is broadcast; where that is not enough for all rows they are dealt to several filters by
another hash, each over its own part of the digests, one after the other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import cut, filter_bits, fresh, join_groups, pack_slots, probe, split_rows, table

#: Runs of white space that are not one plain space already.
SPACE_RUN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


#: Slots of a row: two at 32 bits a row let 4 of 1000 unique rows through.
HASHES = 2


def normalised(text: Column) -> Column:
    """Null as empty, every run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def told_apart(hashed: DataFrame, rows: int, bits_per_row: int, max_bytes: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``hashed`` (id, sha) whose digest may be there twice, and those that surely are alone."""
    bits = filter_bits(rows, bits_per_row, max_bytes)
    slots = [F.pmod(F.xxhash64("sha", F.lit(k)), F.lit(bits)) for k in range(HASHES)]
    names = [f"slot{k}" for k in range(HASHES)]
    hit = hashed.select(F.explode(F.array(*slots)).alias("slot")).groupBy("slot").agg(F.count(F.lit(1)).alias("n"))
    maps = cut(pack_slots(hit.filter("n > 1").select("slot"), "slot"))
    marked = hashed.withColumns(dict(zip(names, slots, strict=True)))
    for name in names:
        marked = probe(marked, maps, name, f"{name}_twice")
    maybe = F.col(f"{names[0]}_twice")
    for name in names[1:]:
        maybe = maybe & F.col(f"{name}_twice")
    return marked.filter(maybe).select("id", "sha"), marked.filter(~maybe).select("id", "sha")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 32, max_filter_bytes: int = 256 << 20) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Null texts equal empty ones.  Of equal texts the smallest id stays; rows that share
    id and text are one document and are all marked kept.  A null id is never smaller
    than another; a group of null ids only keeps them.  An empty table gives no rows.
    Other columns, whatever their names, are not looked at.
    """
    hashed = cut(docs.select(F.col(id_col).alias("id"), F.sha2(normalised(F.col(text_col)), 256).alias("sha")))
    total = hashed.count()
    filters = math.ceil(total * bits_per_row / (8 * max_filter_bytes))
    if filters <= 1:
        maybe, alone = told_apart(hashed, total, bits_per_row, max_filter_bytes)
    else:
        path = table(hashed.withColumn("part", F.pmod(F.xxhash64("sha", F.lit(-1)), F.lit(filters)).cast("int")), "part")
        parts = []
        for k in range(filters):  # one broadcast at a time: each part's rows are written before the next
            own = path.filter(F.col("part") == k).select("id", "sha")
            several, single = told_apart(own, -(-total // filters), bits_per_row, max_filter_bytes)
            parts.append(table(several.withColumn("alone", F.lit(False)).unionByName(single.withColumn("alone", F.lit(True)))))
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        maybe, alone = rows.filter("NOT alone").select("id", "sha"), rows.filter("alone").select("id", "sha")
    alone = alone.select("id", "sha", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    groups = cut(maybe.groupBy("sha").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    rows = alone.unionByName(join_groups(maybe, groups, "sha", "group_size", total))
    return rows.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each text, that with the smallest id; all columns stay.  Of
    repeated rows that share id and text any one stays.  Null texts equal empty ones, and of a
    group of null ids one row stays.  Only rows that may have a copy are shuffled; an empty
    table stays empty."""
    sha, gid, gsha, kept = fresh(docs, "_sha", "_gid", "_gsha", "_kept")
    marks = duplicate_groups(docs, id_col, text_col).filter("group_size > 1")
    marks = cut(marks.select(F.col(id_col).alias(gid), F.col("text_sha256").alias(gsha), F.col("kept").alias(kept)).distinct())
    hashed = docs.withColumn(sha, F.sha2(normalised(F.col(text_col)), 256))
    may, rest = split_rows(hashed, F.col(sha), marks, F.col(gsha), marks.count())
    found = may.join(marks, (F.col(sha) == F.col(gsha)) & F.col(id_col).eqNullSafe(F.col(gid)), "left").filter(F.coalesce(F.col(kept), F.lit(True)))
    single = found.filter(F.col(gsha).isNull()).select(*hashed.columns)
    copied = found.filter(F.col(gsha).isNotNull()).select(*hashed.columns).dropDuplicates([id_col, sha])
    return rest.unionByName(single).unionByName(copied).drop(sha)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = r"""
WITH h AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM h
"""
