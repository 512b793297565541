"""Connected components by alternating large-star and small-star rounds, with lineage cut each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, spread_join, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return spread_join(both.where("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = spread_join(down, least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(a, b) long edges -> (node, root): every node that has an edge, and the least node of its component.

    Self-loops and repeated edges may occur; no edges give no rows. Each round writes the edges
    to the shared folder and deletes those of the round before; the loop ends when a round
    changes nothing and fails beyond ``rounds`` (rounds grow with the logarithm of the longest
    path). The edges of a node with very many are dealt to many tasks.
    """
    spark = edges.sparkSession
    edges, old = stored(edges.where("a <> b").distinct(), "edges")
    if edges.isEmpty():
        return edges.toDF("node", "root")
    seen = None
    for _ in range(rounds):
        half, between = stored(_large_star(edges), "stars")
        edges, new = stored(_small_star(half).where("a <> b").distinct(), "edges")
        remove(spark, old, between)
        old = new
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
        seen = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")
