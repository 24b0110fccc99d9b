"""Joins over intervals: overlap, containment, nearest, and left joins with a fixed rule for repeated keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.operators.intervals import bin_of

#: Width of a join bin in positions: intervals are copied to each bin that they touch.
JOIN_BIN = 1 << 14


def overlaps(a_s: Column, a_e: Column, b_s: Column, b_e: Column) -> Column:
    """Strict half-open overlap: touching intervals don't."""
    return (a_s < b_e) & (b_s < a_e)


def contains_strictly(outer_s: Column, outer_e: Column, s: Column, e: Column) -> Column:
    """Strict at both ends."""
    return (outer_s < s) & (outer_e > e)


def overlap_join(a: DataFrame, b: DataFrame, by: Sequence[str], keep_all: Sequence[str] = (), width: int = JOIN_BIN) -> DataFrame:
    """Pairs of rows that overlap and agree on ``by``; a's columns, then b's with the prefix b_ (``by`` once).

    An equi-join on (by, bin) with the range test left over; a pair is found in the bin of the later start only, so no distinct is needed.
    Empty intervals meet nothing. With keep_all, columns that tell a's rows apart, rows without a partner stay, with nulls.
    """
    by = list(by)
    bins = lambda df: F.explode(F.sequence(bin_of("s", width), bin_of(F.greatest(F.col("e") - 1, F.col("s")), width)))
    right = b.select(*by, *(F.col(c).alias(f"b_{c}") for c in b.columns if c not in by), bins(b).alias("_bin"))
    here = bin_of(F.greatest("s", "b_s"), width) == F.col("_bin")
    new = [c for c in right.columns if c.startswith("b_")]
    met = a.withColumn("_bin", bins(a)).join(right, [*by, "_bin"]).where(overlaps(F.col("s"), F.col("e"), F.col("b_s"), F.col("b_e")) & here).select(*a.columns, *new)
    if not keep_all:
        return met
    alone = a.join(met.select(*keep_all).distinct(), list(keep_all), "left_anti").select(*a.columns, *(F.lit(None).cast(met.schema[c].dataType).alias(c) for c in new))
    return met.unionByName(alone)


def nearest(a: DataFrame, b: DataFrame, by: str, side: str, max_dist: int, a_id: str, b_id: str, width: int = 1 << 20) -> DataFrame:
    """a's rows that have a neighbour, with b_id and dist: the nearest interval of b wholly to the left or right of a.

    The gap must be at least 1 (touching neighbours are not seen) and at most max_dist; the smallest b_id among equally near ones. An as-of
    scan in bins of positions, with the best candidate of all earlier bins carried over; no task scans a whole chromosome.
    """
    # Mirrored for the right side, so that one rule holds: the candidate with the greatest end at or before the position.
    a_pos = F.col("s") - 1 if side == "left" else -(F.col("e") + 1)
    b_pos = F.col("e") if side == "left" else -F.col("s")
    asks = a.select(F.col(by).alias("_by"), a_pos.alias("pos"), F.lit(1).alias("kind"), F.col(a_id).alias("a"), F.lit(None).cast(b.schema[b_id].dataType).alias("b"))
    offers = b.groupBy(F.col(by).alias("_by"), b_pos.alias("pos")).agg(F.min(b_id).alias("b"))
    offers = offers.select("_by", "pos", F.lit(0).alias("kind"), F.lit(None).cast(a.schema[a_id].dataType).alias("a"), "b")
    both = asks.unionByName(offers).withColumn("_bin", bin_of("pos", width))
    found = F.when(F.col("kind") == 0, F.struct("pos", "b"))
    per_bin = both.groupBy("_by", "_bin").agg(F.max(found).alias("_v"))
    earlier = W.partitionBy("_by").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    carry = per_bin.select("_by", "_bin", F.max("_v").over(earlier).alias("_carry"))
    order = W.partitionBy("_by", "_bin").orderBy("pos", "kind").rowsBetween(W.unboundedPreceding, 0)
    best = both.withColumn("_hit", F.last(found, ignorenulls=True).over(order)).join(carry, ["_by", "_bin"]).where("kind = 1").withColumn("_hit", F.coalesce("_hit", "_carry"))
    near = best.where("_hit IS NOT NULL").select(F.col("a").alias("_a"), F.col("_hit.b").alias(f"near_{b_id}" if b_id == a_id else b_id), (F.col("pos") + 1 - F.col("_hit.pos")).alias("dist"))
    return a.join(near.where(F.col("dist") <= max_dist), F.col(a_id) == F.col("_a")).drop("_a")


def nearest_within(a: DataFrame, b: DataFrame, by: Sequence[str], n: int, max_dist: int, a_id: str, b_id: str) -> DataFrame:
    """(a_id, side, b_id, dist, rank): up to n nearest intervals on each side, gaps from 1 to max_dist, ties by b_id."""
    wide = a.select(*by, a_id, F.col("s").alias("o_s"), F.col("e").alias("o_e"), (F.col("s") - max_dist - 1).alias("s"), (F.col("e") + max_dist + 1).alias("e"))
    shifted = overlap_join(wide, b.select(*by, "s", "e", F.col(b_id).alias("id")), by)
    left, right = F.col("o_s") - F.col("b_e"), F.col("b_s") - F.col("o_e")
    sided = shifted.withColumn("side", F.when(left >= 1, "left").when(right >= 1, "right")).withColumn("dist", F.when(left >= 1, left).otherwise(right)).where(F.col("side").isNotNull() & (F.col("dist") <= max_dist))
    ranked = sided.withColumn("rank", F.row_number().over(W.partitionBy(a_id, "side").orderBy("dist", "b_id")))
    return ranked.where(F.col("rank") <= n).select(a_id, "side", F.col("b_id").alias(f"near_{b_id}"), "dist", "rank")


def stream_side(strand: Column, where: str) -> Column:
    """left or right of an interval for upstream and downstream; unstranded counts as +."""
    a, b = ("left", "right") if where == "upstream" else ("right", "left")
    return F.when(strand == "-", b).otherwise(a)


def stream_neighbours(a: DataFrame, b: DataFrame, by: Sequence[str], where: str, n: int, max_dist: int, a_id: str, b_id: str) -> DataFrame:
    """nearest_within on the upstream or downstream side of each stranded a."""
    near = nearest_within(a, b, by, n, max_dist, a_id, b_id)
    return near.join(a.select(a_id, "strand"), a_id).where(F.col("side") == stream_side(F.col("strand"), where)).drop("strand")


def annotate_names(exon_rows: DataFrame, features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names of overlapping features on the same strand, distinct, sorted, joined by commas ('' without any): per exon (tid, s, e, names) and per
    transcript (tid, names). features: chrom, s, e, strand, name."""
    hits = overlap_join(exon_rows.select("chrom", "strand", "tid", "s", "e"), features.select("chrom", "strand", "s", "e", "name"), ["chrom", "strand"], keep_all=["tid", "s", "e"])
    names = F.array_join(F.array_sort(F.collect_set("b_name")), ",")
    return hits.groupBy("tid", "s", "e").agg(names.alias("names")), hits.groupBy("tid").agg(names.alias("names"))


def last_by_key(df: DataFrame, key: str, position: str) -> DataFrame:
    """One row per key: the one with the greatest position."""
    return df.groupBy(key).agg(F.max_by(F.struct(*(c for c in df.columns if c != key)), F.col(position)).alias("_r")).select(key, "_r.*")


def left_join_table(df: DataFrame, other: DataFrame, on: str, other_on: str, position: str, missing: str = "NA") -> DataFrame:
    """Left join with a text table: of rows with one key the last counts, misses are filled with ``missing``; adds ``matched``."""
    extra = [c for c in other.columns if c not in (other_on, position)]
    last = last_by_key(other, other_on, position).select(F.col(other_on).alias(on), *extra, F.lit(True).alias("matched"))
    joined = df.join(last, on, "left")
    return joined.select(*df.columns, *(F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias(c) for c in extra), F.coalesce("matched", F.lit(False)).alias("matched"))


def first_match_join(df: DataFrame, other: DataFrame, on: str, order: Sequence[str]) -> DataFrame:
    """Left join with the first matching row of other by ``order``."""
    best = other.withColumn("_n", F.row_number().over(W.partitionBy(on).orderBy(*order))).where("_n = 1").drop("_n")
    return df.join(best, on, "left")


def shared_introns(a: DataFrame, b: DataFrame, by: Sequence[str] = ("chrom", "strand", "s", "e")) -> DataFrame:
    """Pairs (a_tid, b_tid, n) and how many introns (by: chromosome, strand and both ends) they share."""
    left, right = a.select(*by, F.col("tid").alias("a_tid")), b.select(*by, F.col("tid").alias("b_tid"))
    return left.join(right, list(by)).groupBy("a_tid", "b_tid").agg(F.count(F.lit(1)).alias("n"))


def splicing_patterns(intron_rows: DataFrame) -> DataFrame:
    """(tid, chrom, strand, pattern): the ordered introns of each transcript that has any, as one text."""
    one = F.struct("s", F.concat_ws("-", F.col("s").cast("string"), F.col("e").cast("string")).alias("t"))
    return intron_rows.groupBy("tid", "chrom", "strand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]), ",").alias("pattern"))


def known_junctions(found: DataFrame, known: DataFrame) -> DataFrame:
    """(lib, known, novel, no_chrom): distinct junctions (chrom, s, e, lib) that a reference set has, lacks, or can't have as it lacks the chromosome."""
    ref = known.select("chrom", "s", "e").distinct().withColumn("_known", F.lit(True))
    chroms = known.select("chrom").distinct().withColumn("_chrom", F.lit(True))
    tagged = found.select("lib", "chrom", "s", "e").distinct().join(ref, ["chrom", "s", "e"], "left").join(chroms, "chrom", "left")
    return tagged.groupBy("lib").agg(F.count_if(F.col("_known").isNotNull()).alias("known"), F.count_if(F.col("_known").isNull() & F.col("_chrom").isNotNull()).alias("novel"), F.count_if(F.col("_chrom").isNull()).alias("no_chrom"))


def lookup_join(rows: DataFrame, table: DataFrame, key: str, weight: str, how: str = "left") -> DataFrame:
    """rows joined with a staged table of one row per key, whose column weight (dropped) is the number of rows that have the key.

    Keys with over a thousandth of all rows, of which there are under a thousand, are broadcast, so that no task gets them whole; the
    others are shuffled. how: left or inner.
    """
    total = table.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    is_hot = F.col(weight) * 1000 > total
    added = [c for c in table.columns if c not in (key, weight)]
    hot = table.where(is_hot & F.col(key).isNotNull()).select(key, F.struct(F.lit(1).alias("_"), *added).alias("_hot"))
    if hot.isEmpty():
        return rows.join(table.drop(weight), key, how)
    met = rows.join(F.broadcast(hot), key, "left")
    cold = met.where("_hot IS NULL").drop("_hot").join(table.where(~is_hot | F.col(key).isNull()).drop(weight), key, how)
    warm = met.where("_hot IS NOT NULL").select("*", *(F.col("_hot")[c].alias(c) for c in added)).drop("_hot")
    return cold.unionByName(warm)
