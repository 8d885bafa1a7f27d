"""Connected components of links by alternating large-star and small-star rounds.

Each round is a pre-aggregated minimum per node and a join, so a node with very many links is no task of its own; the
lineage is cut by a written table after every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybar.llm.common import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of its neighbours and itself."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, is linked to the smallest of them."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    moved = edges.join(least, "v").select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v"))
    return moved.where("u != v").distinct()


def connected_components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link to another; root is the smallest node of its component.

    links: two columns of longs, in any order and number; rows with nulls or equal ends link nothing.
    """
    a, b = links.columns
    edges = links.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()
    edges = materialize(spark, edges, "links")
    mark = None
    while True:
        found = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if found["n"] == 0 or (found["n"], found["s"]) == mark:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
        mark = (found["n"], found["s"])
        before, edges = edges, materialize(spark, _small_star(_large_star(edges)), "links")
        discard(spark, before)
