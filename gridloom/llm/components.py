"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def stars(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node of ``edges`` (a, b; long) but the smallest ones themselves.

    Each step points neighbours at the least node around; the edges end as one star per component, and
    that they do is seen from the edges, not from a further step.
    Steps are checkpointed and grow with the logarithm of the longest path. Nothing but that answer
    reaches the driver, whose memory grows with the exchanges of all steps: each keeps a thread for a minute. A node with many
    neighbours is met by partial minima and by a join whose other side has one row per node.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not are_stars(edges):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        edges = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(moved.union(least.select("a", F.col("m").alias("b"))).distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def are_stars(edges: DataFrame) -> bool:
    """Whether no node has two edges to smaller nodes, or one and is met by another. Edges (a, b) are distinct, a > b."""
    ends = edges.select("a", F.lit(1).alias("down"), F.lit(0).alias("met")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("a").agg(F.sum("down").alias("down"), F.max("met").alias("met")).where("down > 0 and down + met > 1").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node of ``edges`` (a, b; long)."""
    found = stars(edges)
    return found.union(found.select("component", "component").distinct())
