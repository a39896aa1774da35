"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import saved


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b): label is the component's smallest node.

    Each round is two joins of the edges with every node's smallest neighbour; the rounds grow as the
    logarithm of the longest path, and edges that are stars already need none. Edges are written between rounds, never collected.
    """
    now = saved(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    while not _stars(now):
        # large star: a node's larger neighbours go to its smallest neighbour (or itself)
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a < b").distinct()
        # small star: a node's smaller neighbours and itself go to the smallest of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a < b").distinct()
        now = saved(small)
    return now.select(F.col("b").alias("node"), F.col("a").alias("label")).union(now.select("a", "a").distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node of edges (a < b, each once) is on one side only and has one smaller neighbour at most."""
    ends = edges.select(F.col("a").alias("node"), F.lit(0).alias("up")).union(edges.select("b", F.lit(1)))
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count(F.lit(1)).alias("n"))
    return seen.filter("up > 1 or up = 1 and n > 1").isEmpty()
