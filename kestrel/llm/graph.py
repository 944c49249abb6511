"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import cut


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return r["n"], r["x"]


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for each node of ``edges(a, b)`` (64-bit integers): the
    component is named by its smallest node.

    Large-star and small-star rounds: every node links what it sees to the
    smallest node it sees, until nothing but stars is left, in a number of
    rounds that grows with the logarithm of the longest path.  Neighbourhoods
    are joined and aggregated, never collected, and each round is checkpointed.
    Loops are ignored, repeated edges count once.
    """
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                .where(F.col("a") != F.col("b")).distinct())
    before = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.where(F.col("b") > F.col("a")).join(low, "a")
                 .select(F.col("m").alias("a"), "b").where(F.col("a") != F.col("b")).distinct())
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = (large.join(low, "b").select("m", F.explode(F.array("a", "b")).alias("b"))
                 .where(F.col("m") != F.col("b")).select(F.col("m").alias("a"), "b").distinct())
        edges = cut(small)
        now = _mark(edges)
        if now == before:
            break
        before = now
    star = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return star.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
