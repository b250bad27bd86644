"""Cutting lineage so that loops stay cheap to plan and survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  A temporary one stands in for it only in local mode; on
    a cluster without a configured folder this raises."""
    sc = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not told and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(told or tempfile.mkdtemp(prefix="hornspark-"))
    return told or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there from now on.

    What comes back knows nothing of the plan that made it: a checkpoint hands on that plan's
    estimate of its size, a product over all joins, and in a loop these numbers grow with every
    round until the driver does nothing but multiply them."""
    spark = df.sparkSession
    shared_folder(spark)
    kept = df.checkpoint(eager=True)
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept._jdf.queryExecution().toRdd(), kept._jdf.schema(), False), spark)


def split(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, with a folder for each value of ``tag``.
    Rows are dealt evenly, so that a large value has several files and a small one few."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/split-{uuid.uuid4().hex}"
    df.hint("rebalance", tag).write.partitionBy(tag).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
