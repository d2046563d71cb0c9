"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns ``a, b``); the root is the component's smallest node.

    Each round takes every node's smallest neighbouring label and then that label's own, so the rounds grow with the
    logarithm of a component's diameter. Loops and repeated edges are harmless; no edges give an empty table.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "links")
    current = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")), "labels")
    labels = current
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        met = labels.join(near, labels["node"] == near["a"]).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("of"), F.col("root").alias("further"))
        moved = stored(met.join(jump, met["root"] == jump["of"], "left").select("node", "old", F.least("root", "further").alias("root")), "labels")
        release(current)
        current, labels = moved, moved.select("node", "root")
        if not moved.where("old <> root").head(1):
            release(both)
            return labels
