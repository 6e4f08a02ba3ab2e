"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import as_table, drop_table, work_folder


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node is tied to the least of the node and its neighbours."""
    pairs = _both_ways(edges)
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return pairs.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them (edges hold a < b)."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    own = least.select(F.col("m").alias("a"), "b")
    moved = edges.join(least, "b").where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return own.union(moved).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is its component's least node.

    Each round is written to the shared folder; rounds end when one changes nothing, after about
    the logarithm of the longest chain.  Loops (a = b) are dropped, repeated edges count once; no
    edges give no rows.
    """
    spark, folder = edges.sparkSession, work_folder(edges.sparkSession)
    now = as_table(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                   .where("a < b").distinct(), f"{folder}/0")
    seen, n = None, 0
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if n:
            drop_table(spark, f"{folder}/{n - 1}")
        if state == seen or not state[0]:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
                now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        seen, n = state, n + 1
        now = as_table(_small_star(_large_star(now)), f"{folder}/{n}")
