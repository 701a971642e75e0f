"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import scratch_path


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node goes to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, go to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u")
    return (
        moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(least.select("u", F.col("m").alias("v")))
        .filter("u <> v")
        .distinct()
    )


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Every node is either a leaf with one centre, or a centre: nothing is left to move."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in"))
    )
    nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
    return nodes.filter("out > 1 or (out > 0 and `in` > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``u, v`` of one comparable type): the smallest node it is connected with.

    Each round is written to the shared folder. Neighbourhoods are only
    aggregated and joined, never gathered; adaptive execution splits hubs.
    """
    pairs = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    state = _stored(pairs.distinct(), "edges")
    while not _is_forest_of_stars(state):
        state = _stored(_small_star(_large_star(state)), "edges")
    roots = state.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
