"""Connected components by alternating star contractions over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadscope.llm.common import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.max("u")).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in an edge of (u, v); root is the smallest node it reaches.

    Both steps only take minima per node, which combine before the shuffle, and join them back, where
    Spark splits a hot node; no neighbour list is gathered. The edge table is written out after each
    round, so a lost executor costs one round at most. Loops and null ends are ignored.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, seen = cut_lineage(edges), None
    while (now := _state(edges)) != seen:
        seen = now
        if not now[0]:
            break
        edges = cut_lineage(_small_star(_large_star(edges)))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v")).distinct()
