"""Connected components of a graph given as a frame of edges, by hooking and pointer jumping on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _jump(parent: DataFrame) -> DataFrame:
    """Let every node (u, p) point at the root of its tree; p < u or p is a root, so there are no cycles."""
    while True:
        up = parent.select(F.col("u").alias("p"), F.col("p").alias("top"))
        jumped = cut(parent.join(up, "p", "left").select("u", F.coalesce("top", "p").alias("top"), (F.col("top") < F.col("p")).alias("moved")))
        parent = jumped.select("u", F.col("top").alias("p"))
        if jumped.filter("moved").isEmpty():
            return parent


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge; the component is its least node.

    In each round every node hooks onto its least neighbour, the trees are flattened and become the nodes of the next
    round; the number of rounds grows with the logarithm of the longest path. Hubs are pre-aggregated.
    """
    edges = cut(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a < b").distinct())
    found = None
    while not edges.isEmpty():
        both = edges.select(F.col("b").alias("u"), F.col("a").alias("v")).unionByName(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
        parent = _jump(cut(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p"))))
        if found is None:
            found = parent.select(F.col("u").alias("node"), F.col("p").alias("component"))
        else:
            step = parent.select(F.col("u").alias("component"), "p")
            found = cut(found.join(step, "component", "left").select("node", F.coalesce("p", "component").alias("component")))
        for side in ("a", "b"):
            edges = edges.join(parent.select(F.col("u").alias(side), "p"), side, "left").withColumn(side, F.coalesce("p", side)).drop("p")
        edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found
