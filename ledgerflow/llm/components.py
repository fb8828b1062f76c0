"""Connected components of a link table, on Spark.

Alternating large-star and small-star steps: every node is linked to the smallest
node it knows, until nothing changes. The number of rounds grows with the logarithm of the longest
chain. Each round joins the links with one minimum per node, so a node with very many links
is split like any skewed join and never gathered; each round ends in a reliable checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import keep


def _large_star(links: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u != v").distinct())


def _small_star(links: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them. Every link is (larger, smaller)."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for all nodes but the roots themselves.

    ``links`` holds columns ``u`` and ``v`` (long), in any direction, repeated or not.
    """
    now = keep(links.where("u != v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        after = keep(_small_star(_large_star(now)))
        # Finished when every node has one link and no link's end is linked further: a forest of stars.
        state = after.agg(F.count("u").alias("n"), F.countDistinct("u").alias("nodes")).first()
        chained = after.select(F.col("v").alias("u")).join(after.select("u"), "u", "left_semi").limit(1).count()
        now = after
        if state["n"] == state["nodes"] and not chained:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
