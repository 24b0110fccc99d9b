"""Connected components by alternating large-star and small-star rounds, all of them joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.sources.stages import discard, stage, stage_and_count


def _printed(edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """An edge set written, and its fingerprint."""
    return stage_and_count(edges, name, F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31))))


def _hang(pairs: DataFrame, least: DataFrame, on: str, node: str) -> DataFrame:
    met = pairs.join(least, on).where(F.col(node) != F.col("m"))
    return met.select(F.col(node).alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of any type that has an order, any direction, repeats and loops allowed -> (node, component): one row per node that has
    an edge to another; component is its smallest reachable node. Each round is written to the shared folder, and the round before it
    deleted; log-many rounds are needed, however long the chains are."""
    ordered = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, seen = _printed(ordered, "edges")
    while seen[0]:
        # Large star: the larger neighbours of a node hang on the least of its neighbourhood.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = stage(_hang(both.where("v > u"), least, "u", "v").distinct(), "large-star")
        # Small star: a node and its smaller neighbours hang on the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _hang(large, least, "u", "v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        before = seen
        small, seen = _printed(small, "small-star")
        discard(now, large)
        now = small
        if seen == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
