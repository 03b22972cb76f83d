"""Connected components by joins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from .common import checkpoint, settled

#: Rows of a graph that one task takes.
ROWS_A_TASK = 50_000


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the ends of ``edges`` (a, b); comp is the smallest node reached.

    Each round takes the smallest label among neighbours and then the label of
    that label, so that paths halve; labels and edges stay distributed, and
    every round is checkpointed (``settled``).
    """
    edges = checkpoint(edges.select("a", "b"))
    parts = max(6, math.ceil(edges.count() / ROWS_A_TASK))  # else a few rows are dealt over all shuffle partitions, round by round
    both = settled(edges.union(edges.select("b", "a")).toDF("node", "other").distinct().coalesce(parts))
    labels = settled(both.groupBy("node").agg(F.min("other").alias("_m")).select("node", F.least("node", "_m").alias("comp")).coalesce(parts))
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "comp"), "other").groupBy("node").agg(F.min("comp").alias("_near"))
        step = labels.join(near, "node").select("node", F.col("comp").alias("_old"), F.least("comp", "_near").alias("_c"))
        above = labels.select(F.col("node").alias("_c"), F.col("comp").alias("_up"))
        step = settled(step.join(above, "_c").select("node", "_old", F.least("_c", "_up").alias("comp")).coalesce(parts))
        labels = step.select("node", "comp")
        if step.where("comp <> _old").isEmpty():
            return labels
