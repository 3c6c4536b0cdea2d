"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_table


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); root: least node.

    Each round first hangs every larger neighbour of a node on the least of
    its neighbourhood, then every node's smaller ones; depth shrinks
    geometrically.  Edges are only aggregated and equi-joined, never gathered.
    """
    now = shared_table(_canonical(edges.select("u", "v")), "edges")
    seen = _mark(now)
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = shared_table(_canonical(large), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        tips = least.select("u", F.col("m").alias("v"))
        now = shared_table(_canonical(small.unionAll(tips)), "edges")
        mark = _mark(now)
        if mark == seen:
            break
        seen = mark
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _canonical(edges: DataFrame) -> DataFrame:
    """Distinct edges with u > v."""
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
