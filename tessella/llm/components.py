"""Connected components of links, as tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stage


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of each node link to its least neighbour (or itself)."""
    both = links.union(links.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours link to the least of them; links go from larger to smaller."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """Of links (a, b): node and component (its least node), for all nodes with a link.

    Large-star and small-star steps alternate until nothing changes; each step's links are a written table, so a lost
    executor costs one step. The number of steps grows with the logarithm of the longest path.
    """
    spark = links.sparkSession
    now = links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, path = stage(now, "links")
    state = None
    while True:
        after, new_path = stage(_small_star(_large_star(now)), "links")
        drop(spark, path)
        now, path = after, new_path
        new = tuple(now.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("a", "b"), 20))).first())
        if new == state:
            break
        state = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
