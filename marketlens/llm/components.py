"""Connected components by contraction to the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b), which are longs; the root is a node of the component, the same for all of it.

    Each round maps every node to its smallest neighbour or itself and keeps the edges between different images, so a star ends in one
    round and the number of nodes at least halves. Counts of edges are all the driver sees.
    """
    edges = materialize(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while labels is None or edges.limit(1).count():
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).union(edges.select(F.col("b").alias("v"), F.col("a").alias("w")))
        least = materialize(both.groupBy("v").agg(F.least(F.col("v"), F.min("w")).alias("m")), "smallest")
        first = least.select(F.col("v").alias("a"), F.col("m").alias("ma"))
        second = least.select(F.col("v").alias("b"), F.col("m").alias("mb"))
        moved = edges.join(first, "a").join(second, "b").where(F.col("ma") != F.col("mb"))
        moved = materialize(moved.select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).distinct(), "edges")
        if labels is None:
            new = materialize(least.select(F.col("v").alias("node"), F.col("m").alias("root")), "labels")
        else:
            now = least.select(F.col("v").alias("root"), "m")
            new = materialize(labels.join(now, "root", "left").select("node", F.coalesce("m", "root").alias("root")), "labels")
            discard(labels)
        discard(edges)
        discard(least)
        labels, edges = new, moved
    return labels
