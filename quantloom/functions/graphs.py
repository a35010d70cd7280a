"""Connected components by contraction: every star of the graph becomes one node, until no edges are left between different ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..stored import drop, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label for each node of an edge: the least node that it is connected with, over any number of edges.

    In each round every node joins the least of its neighbours and itself, where that one is a star's centre; the number of rounds grows with the
    logarithm of the longest chain. Nulls and loops are passed over.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    nodes = stored(pairs.select("a").union(pairs.select("b")).toDF("node").distinct(), "nodes")
    left = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not left.isEmpty():
        both = left.select(F.col("a").alias("node"), F.col("b").alias("near")).union(left.select("b", "a"))
        least = both.groupBy("node").agg(F.least("node", F.min("near")).alias("to"))
        # a node whose least neighbour itself moves on follows it, so chains halve
        step = least.join(least.select(F.col("node").alias("to"), F.col("to").alias("further")), "to").select("node", F.col("further").alias("to"))
        step = stored(step, "step")
        told = step.select(F.col("node").alias("label"), F.col("to").alias("later"))
        new = stored(step.select("node", F.col("to").alias("label")) if labels is None else labels.join(told, "label", "left").select("node", F.coalesce("later", "label").alias("label")), "labels")
        for x, y in (("a", "to_a"), ("b", "to_b")):
            left = left.join(step.select(F.col("node").alias(x), F.col("to").alias(y)), x)
        fewer = stored(left.where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
        drop(step)
        if labels is not None:
            drop(labels)
        labels, left = new, fewer
    return nodes.select("node", F.col("node").alias("label")) if labels is None else labels
