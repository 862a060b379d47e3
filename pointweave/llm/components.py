"""Distributed connected components in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.llm.common import cut


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "least").alias("least"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.unionByName(least.select("u", F.col("least").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (two columns of one orderable type): the component's least node.

    Large-star and small-star rounds, each written to the shared folder. Minima are combined before the shuffle, and
    the joins that hand them back can be split by Spark, so a hub with a third of all edges is no single task. No
    edges give no rows; self-loops and repeated edges change nothing; null ends are dropped.
    """
    a, b = edges.columns
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    now = cut(now.distinct(), "edges")
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        now = cut(_small_star(_large_star(now)), "stars")
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("below")).unionByName(now.select(F.col("v").alias("node"), F.lit(0).alias("below")).distinct())
        if ends.groupBy("node").agg(F.sum("below").alias("n"), F.min("below").alias("root")).where("n > 1 or (n = 1 and root = 0)").isEmpty():
            break  # each node hangs on one root and no root on another: stars
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
