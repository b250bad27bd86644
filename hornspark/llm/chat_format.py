"""Chat formatting by perspective rotation, in DataFrame functions only.

A dialogue is rendered once for every participant: that speaker's turns are the
assistant's and carry the loss mask, all others are named users, system turns stay.  The
result has one row per turn of each rendering with its place in the rendered text, so
no task ever holds a whole conversation: turns are dealt by range of (conversation, turn),
places are summed within a range, and the ranges' totals give each its start.  All of this
takes lengths only; the texts, moved once to their ranges, move once more to their places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import cut

SYSTEM = "system"
#: Name of a speaker whose role is null.
NOBODY = "unknown"
END = "\n<|end|>\n"


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv, perspective, seq, role, speaker, segment, char_start, mask_start, mask_end).

    ``seq`` counts the conversation's turns from 0 in the order of turn, role and text,
    nulls first; equal rows are turns of their own.  The mask covers the content and the
    end mark of the perspective's own turns and is null for all others.  Null text is
    empty, a null role speaks as "unknown", null conversations are one conversation, and a
    conversation of system turns only has no perspective.  Places count characters.
    Other columns are not looked at; an empty table gives no rows."""
    t = turns.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit(NOBODY)).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    order = ["conv", "turn", "role", "text"]
    t = t.repartitionByRange(*order).sortWithinPartitions(*order)
    t = cut(t.withColumn("pid", F.spark_partition_id()).withColumn("rid", F.monotonically_increasing_id()))
    slim = t.select("pid", "rid", "conv", "role", F.char_length("text").cast("long").alias("n_text"))
    who = slim.filter(F.col("role") != SYSTEM).select(F.col("conv").alias("c"), F.col("role").alias("perspective")).distinct()
    # a conversation meets its participants range by range, so that a long one is spread
    parts = slim.select("pid", "conv").distinct().join(who, F.col("conv").eqNullSafe(F.col("c")))
    parts = parts.select(F.col("pid").alias("p"), "c", "perspective")
    own = F.col("role") == F.col("perspective")
    speaker = F.when(own, "assistant").when(F.col("role") == SYSTEM, SYSTEM).otherwise("user")
    name = F.when(F.col("speaker") == "user", F.concat(F.lit(" name="), "role")).otherwise("")
    x = (
        slim.join(parts, (F.col("pid") == F.col("p")) & F.col("conv").eqNullSafe(F.col("c")))
        .drop("p", "c")
        .withColumn("speaker", speaker)
        .withColumn("header", F.concat(F.lit("<|"), "speaker", name, F.lit("|>\n")))
        .withColumn("chars", F.char_length("header") + F.col("n_text") + len(END))
    )
    group = ["conv", "perspective"]
    local = Window.partitionBy("pid", *group).orderBy("rid")
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*group).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        x.groupBy("pid", *group)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("m"))
        .select(
            F.col("pid").alias("p"),
            F.col("conv").alias("c"),
            F.col("perspective").alias("v"),
            F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("seq0"),
            F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("char0"),
        )
    )
    placed = x.withColumn("k", F.row_number().over(local) - 1).withColumn("at", F.coalesce(F.sum("chars").over(before), F.lit(0)))
    here = (F.col("pid") == F.col("p")) & F.col("conv").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("v"))
    start = F.col("char0") + F.col("at")
    texts = t.select(F.col("rid").alias("r"), "text")
    return placed.join(starts, here).join(texts, F.col("rid") == F.col("r")).select(
        F.col("conv").alias(conv_col),
        "perspective",
        (F.col("seq0") + F.col("k")).cast("long").alias("seq"),
        "role",
        "speaker",
        F.concat("header", "text", F.lit(END)).alias("segment"),
        start.alias("char_start"),
        F.when(F.col("speaker") == "assistant", start + F.char_length("header")).alias("mask_start"),
        F.when(F.col("speaker") == "assistant", start + F.col("chars")).alias("mask_end"),
    )


def render(segments: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One text and its masks for each (conversation, perspective), for conversations that
    fit in a row."""
    turns = F.array_sort(F.collect_list(F.struct("seq", "segment", "mask_start", "mask_end")))
    masked = F.filter("t", lambda s: s["mask_start"].isNotNull())
    return segments.groupBy(conv_col, "perspective").agg(turns.alias("t")).select(
        conv_col,
        "perspective",
        F.array_join(F.transform("t", lambda s: s["segment"]), "").alias("text"),
        F.transform(masked, lambda s: F.struct(s["mask_start"].alias("start"), s["mask_end"].alias("end"))).alias("masks"),
    )


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS seq
  FROM conversations
), who AS (SELECT DISTINCT conv_id AS c, role AS perspective FROM t WHERE role <> 'system'),
x AS (
  SELECT conv_id, perspective, seq, role, text,
         CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user' END AS speaker
  FROM t JOIN who ON conv_id IS NOT DISTINCT FROM c
), h AS (
  SELECT *, '<|' || speaker || CASE WHEN speaker = 'user' THEN ' name=' || role ELSE '' END || '|>' || chr(10) AS header FROM x
), s AS (SELECT *, header || text || chr(10) || '<|end|>' || chr(10) AS segment FROM h),
p AS (
  SELECT *, CAST(coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY seq
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start FROM s
)
SELECT conv_id, perspective, seq, role, speaker, segment, char_start,
       CASE WHEN speaker = 'assistant' THEN char_start + length(header) END AS mask_start,
       CASE WHEN speaker = 'assistant' THEN char_start + length(segment) END AS mask_end
FROM p
"""
