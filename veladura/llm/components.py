"""Connected components by alternating large and small stars; every step is one written table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import written


def _stars(edges: DataFrame) -> DataFrame:
    """One large star, then one small star, over edges (a, b) with a < b."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
    least = large.groupBy("b").agg(F.min("a").alias("m"))
    small = large.join(least, "b").where(F.col("a") != F.col("m")).select(F.col("m").alias("a"), F.col("a").alias("b"))
    return small.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge (a, b); root is the smallest node it reaches."""
    now = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(F.col("a") < F.col("b")).distinct()
    now = written(now, "edges")
    state = _state(now)
    while state[0]:
        now = written(_stars(now), "edges")
        new = _state(now)
        if new == state:
            break
        state = new
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
