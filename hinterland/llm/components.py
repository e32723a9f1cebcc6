"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hinterland.llm.scratch import Scratch


def _is_star_forest(edges: DataFrame) -> bool:
    centres = edges.select(F.col("v").alias("u")).distinct()
    if edges.join(centres, "u", "left_semi").take(1):
        return False
    return not edges.groupBy("u").count().where("count > 1").take(1)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Label every end of ``edges(u, v)`` with the smallest id it reaches: ``(node, component)``.

    Each step writes its edges to the shared folder and shrinks every component towards a star
    around its smallest id. Minima are pre-aggregated and kept apart from the join that brings
    them back, so that a hot id can be split. Loops and repeated edges do no harm.
    """
    current = scratch.keep(
        edges.where("u <> v").select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _is_star_forest(current):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.keep(
            both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")),
            "low")
        large = scratch.keep(
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).distinct(), "large")
        least = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = scratch.keep(
            large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        scratch.drop(current, low, large, least)
        current = small
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
