"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickloom.llm.release import release
from tickloom.session import checkpoint


def _mark(edges: DataFrame) -> tuple:
    # whole numbers, so that the sum is the same in any order
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 31) - 1)))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the ends of the edges (a, b); the label is the smallest node reached.

    Alternating large and small stars: every node hangs its larger neighbours, then its smaller ones, below
    the smallest it knows. The edges shrink to stars in a logarithmic number of rounds; each round is two
    aggregations with map-side combination and two joins of narrow rows, written to the shared folder.
    Null ends are ignored; no edges give no rows.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = checkpoint(edges.where("a <> b").select(low.alias("a"), high.alias("b")).distinct())
    del edges
    release(now.sparkSession)
    seen = _mark(now)
    while seen[0]:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # small stars: all edges point from the smaller end
        large = checkpoint(large)
        smallest = large.groupBy("b").agg(F.min("a").alias("m"))
        hung = large.join(smallest, "b")
        small = hung.select(F.col("m").alias("a"), "b").union(hung.select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
        now = checkpoint(small)
        mark = _mark(now)
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("b").alias("node"), F.col("a").alias("label")).union(now.select(F.col("a").alias("node"), F.col("a").alias("label"))).distinct()
