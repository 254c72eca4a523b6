"""Connected components of a graph given by its edges, by alternating large-star and small-star steps.

Each step is a minimum per node and a join, so that no neighbourhood is ever gathered in one task; each result is
written to the shared folder. Nodes are long integers. Edges may repeat, point both ways or be loops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def _large_star(e: DataFrame) -> DataFrame:
    """e: (u, v) with v < u. Joins every larger neighbour of a node to the smallest neighbour."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """e: (u, v) with v < u. Joins a node and its smaller neighbours to the smallest of them."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """edges (u, v) -> (node, root) for every node but the smallest one of each component, which is the root."""
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = stored(e)
    for _ in range(rounds):
        # stars are the end: no node is both a root and a leaf, and no leaf has two roots
        ends = e.select("u").unionByName(e.select(F.col("v").alias("u")).distinct())
        if ends.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        e = stored(_small_star(_large_star(e)))
    raise RuntimeError(f"components didn't settle in {rounds} rounds")
