"""Connected components of an edge table, by min-label hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long edges to (v, label): each vertex that has an edge, with its component's smallest vertex.

    Each round takes a neighbourhood minimum (partial aggregation first, so a hub is no hot group), hooks the label's
    root to the smallest minimum found by any member, and jumps one pointer. Rounds grow with the logarithm of the
    diameter. Every round is a written table, so lineage stays short and nothing reaches the driver but one count.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "edges")
    at = last = materialize(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("label")), "labels")
    while True:
        near = both.join(at.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("m"))
        lowest = at.join(near, "v").groupBy("label").agg(F.min(F.least("label", "m")).alias("root"))
        hooked = at.join(lowest, "label").select("v", F.col("label").alias("old"), F.col("root").alias("label"))
        up = hooked.select(F.col("v").alias("label"), F.col("label").alias("top"))
        moved = hooked.join(up, "label").select("v", "old", F.least("label", "top").alias("label"))
        step = materialize(moved, "labels")
        discard(last)
        last, at = step, step.select("v", "label")
        if step.where("old <> label").limit(1).count() == 0:
            discard(both)
            return at
