"""Operator 8: mixing sources to target weights by a low-discrepancy schedule.

The mix is a list of slots. Slot n belongs to the source whose interval of the cumulative target shares holds the golden-ratio point
frac((n + 1) / phi), so any stretch of slots holds each source in nearly its share. A source's documents stand in hash order, and its slots,
ranked, take the successive blocks of that stream, round after round. The blocks of a source are equal up to a word and make up its
target, so a source comes to its target whatever the others are; a source too small for a slot of its own shares the slot at its place. A
document is taken by the words of its span that the taken blocks cover.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.common import stage, table, word_count
from spanloom.operators.filters import running

GOLDEN = (5**0.5 - 1) / 2
#: Most slots of a schedule: how finely sources alternate. A block is the sum of targets over it, or a word.
SLOTS = 1 << 17
_BUCKET_DIGITS = 3  # of a hexadecimal hash: 4096 buckets a source
_CHUNK = 512
_CELLS = 4096


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes (source, source_size) -> source, source_size, weight, target: weights go round by code point order, null last; sources share
    ``share`` times all words by weight, none above ``most`` times its own words, the excess reshared by weight.

    Resharing until none is above ends at one level of words per weight: sources are sorted by the level at which they fill, and the
    level is that of the first source which doesn't fill. Rows: one per source; no window holds all of them.
    """
    df = stage(sizes.withColumn("last", F.col("source").isNull()).withColumn("one", F.lit(1).cast("long")), "mix-sources")
    total = df.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * share
    turn = (F.col("at") % len(weights)).cast("int") + 1
    df = running(df, [], ["last", "source"], {"at": "one"})
    df = df.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), turn))
    df = df.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("fill", F.col("cap") / F.col("weight"))
    df = stage(df.select("last", "source", "source_size", "weight", "cap", "fill"), "mix-fills")
    everything = df.agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    df = running(df, [], ["fill", "last", "source"], {"caps": "cap", "weights": "weight"})
    level = (F.lit(float(total)) - F.col("caps")) / (F.lit(everything) - F.col("weights"))
    df = stage(df.withColumn("level", level), "mix-levels")
    ends = df.where("level <= fill").agg(F.min(F.struct("fill", "last", "source", "level"))["level"]).first()[0]
    target = F.col("cap") if ends is None else F.least(F.col("weight") * F.lit(ends), F.col("cap"))
    return df.select("source", "source_size", "weight", target.alias("target"))


def schedule(goals: DataFrame, slots: int = SLOTS) -> DataFrame:
    """goals (source, target) -> slot, source, block_no (rank of the slot within its source, from 0), blocks (of the source), words (of all its
    blocks: its target, rounded). Sources with a target under half a word have no slot."""
    spark = goals.sparkSession
    shares = goals.withColumn("words", F.round("target").cast("long")).where("words > 0").withColumn("last", F.col("source").isNull())
    shares = stage(shares.select("last", "source", F.col("target").cast("double").alias("target"), "words"), "mix-shares")
    everything = shares.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    used = min(slots, math.ceil(everything))
    spans = running(shares, [], ["last", "source"], {"low": "target"})
    lo, hi = F.col("low") / everything if everything else F.lit(0.0), (F.col("low") + F.col("target")) / everything if everything else F.lit(0.0)
    spans = stage(spans.select("source", "words", lo.alias("lo"), hi.alias("hi")), "mix-spans")
    cell = lambda x: F.least(F.floor(x * _CELLS), F.lit(_CELLS - 1)).cast("int")
    cut = spans.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))))
    points = spark.range(used).select(F.col("id").alias("slot"), ((F.col("id") + 1) * GOLDEN % 1).alias("x")).withColumn("cell", cell(F.col("x")))
    # Neighbouring spans may leave a gap of a rounding error between them: of the spans that begin before the point, the last has it.
    met = points.join(cut, "cell").where("x >= lo").groupBy("slot").agg(F.max(F.struct("lo", "source"))["source"].alias("source"))
    dealt = stage(met.withColumn("chunk", F.floor(F.col("slot") / _CHUNK).cast("int")), "mix-slots")
    counts = dealt.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("n"))
    by = W.partitionBy("source").orderBy("chunk")  # a row per source and chunk of slots
    before = counts.select(F.col("source").alias("s"), F.col("chunk").alias("c"), (F.sum("n").over(by) - F.col("n")).alias("before"))
    ranked = dealt.withColumn("rank", F.row_number().over(W.partitionBy("source", "chunk").orderBy("slot")) - 1)
    ranked = ranked.join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c")))
    ranked = ranked.select("slot", "source", (F.col("rank") + F.col("before")).alias("block_no"))
    blocks = dealt.groupBy("source").agg(F.count(F.lit(1)).alias("blocks"))
    per = spans.join(blocks.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("s"), "words", "lo", "blocks")
    per = stage(per, "mix-blocks")
    full = ranked.join(per.where("blocks IS NOT NULL"), F.col("source").eqNullSafe(F.col("s"))).select("slot", "source", "block_no", "blocks", "words")
    one = F.lit(1).cast("long")
    small = per.where("blocks IS NULL").select(F.floor(F.col("lo") * used).alias("slot"), F.col("s").alias("source"), (one - 1).alias("block_no"), one.alias("blocks"), "words")
    return full.unionByName(small)


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, keep: Sequence[str]) -> DataFrame:
    """Each row's place in its source's stream: start, in words. Rows stand by the MD5 of their identifier, then by it, size and text."""
    text = F.col(text_col)
    size = F.when(text.isNull(), F.lit(0).cast("long")).otherwise(word_count(text))
    kept = F.struct(F.lit(1).alias("_"), *keep)
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(text).alias("tie"), kept.alias("kept"))
    sized = sized.withColumn("turn", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))).withColumn("bucket", F.substring("turn", 1, _BUCKET_DIGITS))
    sized = stage(sized, "mix-sizes")
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    earlier = F.sum("n").over(W.partitionBy("source").orderBy("bucket")) - F.col("n")  # 4096 rows a source at most
    offsets = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), earlier.alias("offset"))
    in_bucket = W.partitionBy("source", "bucket").orderBy("turn", "id", "size", "tie")
    inner = F.sum("size").over(in_bucket.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    placed = sized.withColumn("row", F.row_number().over(in_bucket)).withColumn("start", inner)
    placed = placed.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return placed.select("id", "source", "size", "kept", "bucket", "row", (F.col("start") + F.col("offset")).alias("start"))


def _met(placed: DataFrame, goals: DataFrame, plan: DataFrame, most: float) -> DataFrame:
    """placed with, for each block that meets a row's span: slot, block_no, from_word and to_word of the row; nulls for a row without any."""
    goal = goals.select(F.col("source").alias("gs"), "source_size", "target")
    per = plan.where("block_no = 0").select(F.col("source").alias("bs"), "words", "blocks")
    placed = placed.join(goal, F.col("source").eqNullSafe(F.col("gs"))).join(per, F.col("source").eqNullSafe(F.col("bs")), "left").drop("gs", "bs")
    rounds = placed.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(math.ceil(most) - 1))))
    rounds = rounds.withColumn("lo", F.col("round") * F.col("source_size") + F.col("start"))
    # Block k holds the words from floor(k * words / blocks) on.
    rounds = rounds.withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("words")))
    nos = F.when(F.col("hi") > F.col("lo"), F.sequence(F.expr("((lo + 1) * blocks - 1) div words"), F.expr("(hi * blocks - 1) div words")))
    pieces = rounds.withColumn("no", F.explode_outer(nos))
    met = pieces.join(plan.select("slot", F.col("source").alias("ps"), "block_no"), F.col("source").eqNullSafe(F.col("ps")) & (F.col("no") == F.col("block_no")), "left")
    first, last = F.greatest(F.col("lo"), F.expr("(no * words) div blocks")), F.least(F.col("hi"), F.expr("((no + 1) * words) div blocks"))
    dealt = F.col("block_no").isNotNull()
    return met.withColumn("from_word", F.when(dealt, first - F.col("lo"))).withColumn("to_word", F.when(dealt, F.greatest(last, first) - F.col("lo")))


def _prepared(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[float], share: float, most: float, slots: int, keep: Sequence[str]) -> DataFrame:
    placed = stage(_placed(docs, id_col, text_col, source_col, keep), "mix-placed")
    goals = stage(targets(placed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "mix-targets")
    return _met(placed, goals, stage(schedule(goals, slots), "mix-schedule"), most)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, slots: int = SLOTS, keep: Sequence[str] = ()) -> DataFrame:
    """One row per row of docs: id_col, source, size (words), source_size, target, taken (words, repeats counted), and the columns of keep.

    A source's taken words are its target, rounded. A null source is a source of its own; a null or wordless text has size 0 and nothing of
    it is taken. Repeated rows each have their own place in the stream. An empty table, or one without words, gives targets of 0.
    Deterministic for a given set of rows. Shuffles carry ids and counts, never texts; the stream is laid out in buckets, so no task sees
    a whole source.
    """
    met = _prepared(docs, id_col, text_col, source_col, weights, share, most, slots, keep)
    whole = ["id", "kept", "source", "bucket", "row", "size", "source_size", "target"]
    taken = F.coalesce(F.sum(F.col("to_word") - F.col("from_word")), F.lit(0)).cast("long")
    out = met.groupBy(*whole).agg(taken.alias("taken"))
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "taken", *(F.col("kept")[c].alias(c) for c in keep))


def mixed_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, slots: int = SLOTS) -> DataFrame:
    """The mix itself: slot, source, block_no, id_col, round, from_word, to_word, a row for each stretch of a document in a block. Read in
    order of slot, source, round and place it is the mixed stream; parameters and edge cases as for ``mix``."""
    met = _prepared(docs, id_col, text_col, source_col, weights, share, most, slots, ()).where("to_word > from_word")
    return met.select("slot", "source", "block_no", F.col("id").alias(id_col), "round", "from_word", "to_word")


def op8_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


_SIZE = r"len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))"
OP8_SQL = f"""
WITH s AS (SELECT doc_id, source, {_SIZE} AS size FROM documents),
a AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
b AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM a),
c AS (SELECT *, cap / weight AS fill FROM b),
d AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
    row_number() OVER (ORDER BY fill, source NULLS LAST) AS at_row FROM c),
lv AS (SELECT arg_min(level, at_row) AS level FROM d WHERE level <= fill),
t AS (SELECT source, source_size, least(weight * lv.level, cap) AS target, CAST(round(least(weight * lv.level, cap)) AS BIGINT) AS upto FROM d, lv),
p AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id ROWS UNBOUNDED PRECEDING) - size AS start_pos FROM s),
q AS (SELECT p.*, source_size, target, upto FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target, CAST(greatest(0, least(start_pos + size, upto) - start_pos) + greatest(0, least(source_size + start_pos + size, upto) - source_size - start_pos) AS BIGINT) AS taken FROM q
"""
