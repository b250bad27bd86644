"""Connected components of an edge table, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut, join_groups


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, label) for every id in ``edges`` (a, b): the label is the smallest id reachable.

    Every round takes the smallest label next to each node, then the label's own label,
    so that a label's way to a node is cut by half.  Hubs of many edges are joined as
    ``join_groups`` does.  Raises if the labels are not settled after ``max_rounds``."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut(both.filter("a <> b").distinct())
    total = both.count()
    # the label of a node starts as the smallest of it and its neighbours
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label"), F.count(F.lit(1)).alias("degree")))
    if not total:
        return labels.select(F.col("a").alias("id"), "label")
    for _ in range(max_rounds):
        near = labels.select(F.col("a").alias("b"), F.col("label").alias("near"), "degree")
        least = join_groups(both, near, "b", "degree", total).groupBy("a").agg(F.min("near").alias("near"))
        step = labels.join(least, "a").select("a", "degree", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # many nodes share a label: only the distinct labels are looked up, and they go back as groups
        step = cut(step)
        owners = step.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        jump = owners.join(step.select(F.col("a").alias("label"), F.col("label").alias("further")), "label", "left")
        jump = cut(jump.select("label", "n", F.least("label", F.coalesce("further", "label")).alias("further")))
        labels = cut(join_groups(step, jump, "label", "n", total).select("a", F.col("further").alias("label"), "degree", (F.col("further") != F.col("old")).alias("moved")))
        if not labels.filter("moved").limit(1).count():
            return labels.select(F.col("a").alias("id"), "label")
        labels = labels.drop("moved")
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
