"""A source far smaller than the blocks of a large mix still comes to its target."""

from collections import defaultdict

from pyspark.sql import functions as F

from spanloom.llm import mixing
from tests.llm.test_ops import rows


def test_small_sources_of_a_large_mix_meet_their_targets(spark):
    small = spark.range(60).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 7).alias("text"), F.format_string("s%02d", (F.col("id") / 3).cast("int")).alias("source"))
    large = spark.range(100, 140).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 100_000).alias("text"), F.format_string("t%d", F.col("id") % 2).alias("source"))
    taken, target, size = defaultdict(int), {}, {}
    for r in rows(mixing.mix(small.unionByName(large))):
        taken[r["source"]] += r["taken"]
        target[r["source"]], size[r["source"]] = r["target"], r["source_size"]
    assert len(target) == 22
    block = sum(target.values()) / mixing.SLOTS
    assert all(target[s] < block for s in target if s[0] == "s")  # under one slot
    for s in target:
        assert abs(taken[s] - target[s]) <= 0.5


def test_tiny_sources_beside_a_large_one(spark):
    tiny = spark.range(20).select(F.col("id").alias("doc_id"), F.lit("four words stand here").alias("text"), F.format_string("s%02d", "id").alias("source"))
    large = spark.range(100, 110).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 100_000).alias("text"), F.lit("large").alias("source"))
    got = rows(mixing.mix(tiny.unionByName(large)))
    assert {(r["target"], r["taken"]) for r in got if r["source"] != "large"} == {(8.0, 8)}
    assert sum(r["taken"] for r in got) == round(1.5 * 1_000_080)
