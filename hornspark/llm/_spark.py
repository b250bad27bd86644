"""Spark helpers shared by the text operators: durable cuts, bitmaps, ranks."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Most rows of one Arrow batch handed to Python: long texts come in small batches.
ARROW_ROWS = 256


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share.  A temporary one stands in for it only in local mode; on
    a cluster without a configured folder this raises."""
    sc = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not told and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(told or tempfile.mkdtemp(prefix="ckpt-"))
    return told or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there: lineage ends,
    later jobs read it instead of computing again, and a lost executor loses nothing.

    What comes back knows nothing of the plan that made it: a checkpoint hands on that plan's
    estimate of its size, a product over all joins, and over the rounds of a loop such numbers
    grow until the driver does nothing but multiply them."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    kept = df.checkpoint(eager=True)
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept._jdf.queryExecution().toRdd(), kept._jdf.schema(), False), spark)


def table(df: DataFrame, *parts: str) -> DataFrame:
    """Like ``cut``, as a Parquet table in the shared folder: smaller, and only the columns
    that are asked for are read again; with a folder for each value of ``parts``."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*parts).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def split_rows(df: DataFrame, key: Column, members: DataFrame, member_key: Column, n_members: int) -> tuple[DataFrame, DataFrame]:
    """The rows whose key may be among the members', and those whose key surely is not."""
    slot, may = fresh(df, "_slot", "_may")
    bits = filter_bits(n_members, 16)
    maps = cut(pack_slots(members.select(slot_of(member_key, bits).alias(slot)), slot))
    marked = probe(df.withColumn(slot, slot_of(key, bits)), maps, slot, may).drop(slot)
    return marked.filter(F.col(may)).drop(may), marked.filter(~F.col(may)).drop(may)


def without(df: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """``df`` less the rows whose ``key`` is among ``gone``'s only column.  Only rows that a
    bounded filter lets through are shuffled; null keys stay."""
    (mark,) = fresh(df, "_gone")
    gone = cut(gone.toDF(mark).filter(F.col(mark).isNotNull()).distinct())
    may, rest = split_rows(df, F.col(key), gone, F.col(mark), gone.count())
    return rest.unionByName(may.join(gone, F.col(key) == F.col(mark), "left_anti"))


def arrow_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the rows of an Arrow batch, so that a batch of very long texts fits in memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that clash with none of ``df``'s (Spark compares them without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


# --------------------------------------------------------------------------- bitmaps

#: Bits of one packed bitmap row, fixed by Spark's bitmap functions.
BITMAP_ROW_BITS = 32768


def filter_bits(n_rows: int, bits_per_row: int = 32, max_bytes: int = 64 << 20) -> int:
    """Size of a filter for ``n_rows`` keys, a power of two of at most ``max_bytes`` bytes.
    Beyond that bound a filter lets more rows through; it never loses one."""
    want = max(BITMAP_ROW_BITS, n_rows * bits_per_row)
    return min(1 << math.ceil(math.log2(want)), max_bytes * 8)


def slot_of(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def pack_slots(slots: DataFrame, slot: str) -> DataFrame:
    """Rows (bitmap_no, bitmap): the set of slots as packed bitmaps of 4 KB."""
    return slots.groupBy(F.expr(f"bitmap_bucket_number({slot})").alias("bitmap_no")).agg(
        F.expr(f"bitmap_construct_agg(bitmap_bit_position({slot}))").alias("bitmap")
    )


def probe(df: DataFrame, bitmaps: DataFrame, slot: str, flag: str) -> DataFrame:
    """Add boolean ``flag``: is the row's slot in the bitmaps?  The bitmaps are broadcast;
    ``filter_bits`` bounds them."""
    no, bitmap = fresh(df, "bitmap_no", "bitmap")
    pos = F.expr(f"bitmap_bit_position({slot})")
    byte = F.conv(F.hex(F.substring(F.col(bitmap), (F.floor(pos / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.floor(byte / F.pow(F.lit(2.0), pos % 8)).cast("int") % 2
    joined = df.withColumn(no, F.expr(f"bitmap_bucket_number({slot})")).join(F.broadcast(bitmaps.toDF(no, bitmap)), no, "left")
    return joined.withColumn(flag, F.coalesce(bit == 1, F.lit(False))).drop(bitmap, no)


def semi_filter(df: DataFrame, key: Column, members: DataFrame, member_key: Column, n_members: int) -> DataFrame:
    """Rows of ``df`` whose key may be among the members': a bounded filter ahead of a join,
    so that only rows which can match are shuffled."""
    return split_rows(df, key, members, member_key, n_members)[0]


def may_repeat(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """The ``rows`` rows of ``df`` less most of those whose key is there once: a bounded filter
    ahead of a grouping, for which only slot numbers are shuffled.  Keys that repeat all stay."""
    slot, may = fresh(df, "_slot", "_may")
    bits = filter_bits(rows, 16)
    hit = df.select(slot_of(key, bits).alias(slot)).groupBy(slot).agg(F.count(F.lit(1)).alias("n"))
    maps = cut(pack_slots(hit.filter("n > 1").select(slot), slot))
    return probe(df.withColumn(slot, slot_of(key, bits)), maps, slot, may).filter(F.col(may)).drop(slot, may)


# --------------------------------------------------------------------------- ranks


def grouped_rank(df: DataFrame, keys: list[str], order: list[str], rank: str) -> tuple[DataFrame, DataFrame]:
    """Number the rows of each group from 0, gapless, however large a group is.

    No task sees a whole group: rows are numbered within (input partition, group), and
    the groups' counts per partition give each partition its start.  Returns the ranked
    rows and the table (keys, pid, start, rows)."""
    t = cut(df.withColumn("_pid", F.spark_partition_id()))
    within = Window.partitionBy("_pid", *keys).orderBy(*order)
    local = t.withColumn("_local", F.row_number().over(within).cast("long") - 1)
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(
        t.groupBy("_pid", *keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    )
    out = local.join(starts.drop("_rows"), ["_pid", *keys]).withColumn(rank, F.col("_start") + F.col("_local"))
    return out.drop("_pid", "_local", "_start"), starts


# --------------------------------------------------------------------------- hot keys

#: A key is hot with one in so many rows; so there are at most so many hot keys.
HOT_SHARE = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` joined with the one row of their group in ``groups``.

    The few groups that hold 1/1000 of ``total`` or more (so at most 1000) are broadcast,
    and their rows stay where they are; all others are joined by a shuffle in which no
    key is large."""
    hot = F.broadcast(groups.filter(F.col(size) * HOT_SHARE >= total))
    cold = groups.filter(F.col(size) * HOT_SHARE < total)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))
