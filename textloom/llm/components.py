"""Connected components of a graph held in DataFrames; nothing of it comes to the driver but a count per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b), longs without nulls -> (node, root): the smallest node that each node reaches.

    Every round takes the least label among the neighbours and then follows labels of labels, so that the number of
    rounds grows with the logarithm of the longest path. Each round is cut by a checkpoint. Only nodes of edges appear;
    self-loops and repeated edges change nothing. A round is grouped by node with partial minima, so that a node of very
    many edges is combined before the shuffle.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).filter("a != b").distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("root"))
    labels = cut(labels)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        hooked = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("to"))
        far = labels.select(F.col("node").alias("to"), F.col("root").alias("far"))
        moved = cut(hooked.join(far, "to", "left").select("node", F.least("to", "far").alias("new"), "root"))
        changed = moved.filter("new != root").limit(1).count()
        labels = moved.select("node", F.col("new").alias("root"))
        if not changed:
            return labels
