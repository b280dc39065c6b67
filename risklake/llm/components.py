"""Connected components of an edge table, by alternating star contractions on checkpointed tables.

Each round is a few grouped minima and joins; nothing but counts reaches the driver, and no node's neighbours are ever
collected. Rounds grow with the logarithm of the longest path.

Cases. An edge with a null end, or from a node to itself, links nothing. Repeated edges, in either direction, count once. An
empty edge table gives no rows; nodes without an edge to another are left to the caller. Other columns are ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risklake.llm.common import settle


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").filter((F.col("v") > F.col("u")) & (F.col("v") > F.col("m"))).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.unionByName(least.withColumnRenamed("m", "v")).distinct()


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of longs -> node, root: each node that has an edge to another, with the smallest node it can reach (itself included)."""
    edges = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = settle(edges)
    before = _signature(edges)
    while before[0]:
        edges = settle(_small_star(_large_star(edges)))
        after = _signature(edges)
        if after == before:
            break
        before = after
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
