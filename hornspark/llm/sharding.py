"""Sharding by jump consistent hashing (Lamping and Veach): a stable key goes to one of n
shards without a ring table, and with one shard more only 1 row in n + 1 moves, into the
new shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import fresh, grouped_rank

#: The multiplier of the published generator.
JUMP_MULTIPLIER = 2862933555777941757


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key; all keys jump together until none is left."""
    key = keys.astype(np.uint64, copy=True)
    shard = np.zeros(len(key), np.int64)
    ahead = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    with np.errstate(over="ignore"):
        while len(live):
            shard[live] = ahead[live]
            key[live] = key[live] * np.uint64(JUMP_MULTIPLIER) + np.uint64(1)
            step = (key[live] >> np.uint64(33)).astype(np.float64) + 1.0
            ahead[live] = ((shard[live] + 1) * (float(1 << 31) / step)).astype(np.int64)
            live = live[ahead[live] < shards]
    return shard.astype(np.int32)


def with_shards(df: DataFrame, key: str, counts: dict[str, int]) -> DataFrame:
    """Add, for each name in ``counts``, the key's shard among that many shards.

    The 64-bit key is Spark's xxhash64 of the column, so any type will do; all null keys
    share a shard.  Only the hash goes to Python."""
    (own,) = fresh(df, "_key")
    hashed = df.withColumn(own, F.xxhash64(key))
    schema = hashed.schema
    for name in counts:
        schema = T.StructType([*schema, T.StructField(name, T.IntegerType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(own).to_numpy(zero_copy_only=False).view(np.uint64)
            more = [pa.array(jump_hash(keys, n)) for n in counts.values()]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, *counts])

    return hashed.mapInArrow(place, schema).drop(own)


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Null and empty texts have size 1 and the checksum 0.  Repeated rows go to one shard
    and take a slot each; which of them takes which makes no difference.  An empty table
    gives no rows; other columns are not looked at."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = with_shards(slim, "id", {"shard": shards, "grown_shard": shards + 1})
    ranked, _ = grouped_rank(placed, ["shard"], ["id", "size", "text_crc32"], "slot")
    return ranked.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
