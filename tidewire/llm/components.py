"""Connected components of a link table, with DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, drop_cut


def components(spark: SparkSession, links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable, for every node that has a link. ``links`` has long columns a and b.

    Alternates large-star and small-star steps; every round is cut by a table in the shared folder. The smallest
    neighbour of a node is found by a map-side aggregate, and a hub's links are joined back to it, which adaptive
    execution can split; no node's links are gathered in one place."""
    now = cut(spark, links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(most_rounds):
        # large star: every larger neighbour of a node is linked to the smallest of its neighbours and itself
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: every smaller neighbour of a node, and itself, is linked to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        after = cut(spark, small, "links")
        same = after.count() == now.count() and after.join(now, ["a", "b"], "left_anti").limit(1).count() == 0
        drop_cut(spark, now)
        now = after
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
