"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a minimum per node, combined before its shuffle, and a join with it; both sides
of the join are plain exchanges, so a node with very many links is split by adaptive
execution. Each round is written to the shared folder; only a count comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _least(edges: DataFrame) -> DataFrame:
    return written(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least")), "least")


def _open_nodes(edges: DataFrame) -> int:
    """Nodes that have two links to lesser ones, or links to lesser and to greater ones; without such
    every link goes from a node to its root, and further steps change nothing."""
    up = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    down = edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    ends = up.unionByName(down).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up + down > 1").count()


def components(links: DataFrame) -> DataFrame:
    """links: a, b (bigint, a null links nothing). Returns node, root: the least node that it reaches; nodes
    that have no links or are their own root aren't listed."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while _open_nodes(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_least(both).hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        large = written(large, "large-star")
        least = _least(large)
        small = large.join(least.hint("merge"), "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        small = small.unionByName(least.select("a", F.col("least").alias("b"))).distinct()
        edges = written(small, "small-star")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
