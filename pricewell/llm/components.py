"""Connected components of a graph given as a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewell.session import materialized


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least node around it."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of these. Edges have a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
    return moved.where("a < b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """For each node of an edge: ``node`` and ``component``, the least node that it can reach.

    Loops and null ends are left out; repeated edges count once. Every round is a written table, so no
    lineage grows and lost executors cost one round. The rounds end when each node hangs
    directly on its component's least node, after some log(n) rounds.
    """
    low, high = F.least(a, b).alias("a"), F.greatest(a, b).alias("b")
    now = materialized(edges.where(F.col(a) != F.col(b)).select(low, high).distinct(), "edges")
    while True:
        now = materialized(_small_star(_large_star(now)), "edges")
        # done: no node is both a member and a centre, and each member has one centre
        state = now.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("b").alias("members")).first()
        if state.n == state.members and now.select("a").join(now.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            break
    centres = now.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(centres)
