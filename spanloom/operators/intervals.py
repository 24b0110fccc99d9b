"""Interval algebra. Intervals are 0-based half-open columns ``s`` and ``e``; ``by`` names the columns within which they live.

Nothing here needs a task to hold a whole chromosome: rows are placed in bins of positions, each bin is scanned on its own, and
what crosses bins (the furthest end so far, the number of islands so far) comes from a table with one row per bin.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.operators.filters import running
from spanloom.sources.stages import stage

#: Width of a bin in positions.
BIN = 1 << 20


def bin_of(position: Column | str, width: int = BIN) -> Column:
    return F.floor((F.col(position) if isinstance(position, str) else position) / width).cast("long")


def _carry(df: DataFrame, by: Sequence[str], value: Column, combine, name: str) -> DataFrame:
    """(by, _bin, name): value combined over all earlier bins; null for the first."""
    per_bin = df.groupBy(*by, "_bin").agg(value.alias("_v"))
    earlier = W.partitionBy(*by).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    return per_bin.select(*by, "_bin", combine("_v").over(earlier).alias(name))


def islands(df: DataFrame, by: Sequence[str], max_dist: int = 0, order: Sequence[str] = (), out: str = "island", width: int = BIN, start: str | None = None) -> DataFrame:
    """df with the number (from 1, by position, within ``by``) of its island added: intervals whose gap is at most max_dist are joined, so
    touching ones merge at 0. ``order`` breaks ties after s and e. start: name of a column for where the island begins."""
    by, keep = list(by), df.columns
    binned = df.withColumn("_bin", bin_of("s", width))
    local = W.partitionBy(*by, "_bin").orderBy("s", "e", *order)
    reach = _carry(binned, by, F.max("e"), F.max, "_reach")
    seen = F.greatest(F.max("e").over(local.rowsBetween(W.unboundedPreceding, -1)), F.col("_reach"))
    marked = binned.join(reach, [*by, "_bin"]).withColumn("_fresh", F.when(F.col("s") <= seen + max_dist, 0).otherwise(1))
    begins = F.when(F.col("_fresh") == 1, F.col("s"))
    per_bin = marked.groupBy(*by, "_bin").agg(F.sum("_fresh").alias("_n"), *([F.max(begins).alias("_s")] if start else []))
    earlier = W.partitionBy(*by).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    before = per_bin.select(*by, "_bin", F.sum("_n").over(earlier).alias("_before"), *([F.max("_s").over(earlier).alias("_begun")] if start else []))
    # Among equal intervals the one that starts the island comes first, in whatever order they were scanned before.
    counted = W.partitionBy(*by, "_bin").orderBy("s", "e", F.desc("_fresh"), *order).rowsBetween(W.unboundedPreceding, 0)
    number = F.sum("_fresh").over(counted) + F.coalesce("_before", F.lit(0))
    placed = marked.join(before, [*by, "_bin"]).withColumn(out, number.cast("long"))
    return placed.withColumn(start, F.coalesce(F.max(begins).over(counted), "_begun")).select(*keep, out, start) if start else placed.select(*keep, out)


def clusters(df: DataFrame, by: Sequence[str], max_dist: int = 0, min_count: int = 1, width: int = BIN) -> DataFrame:
    """(by, island, s, e, n): the merged regions with at least min_count members."""
    grouped = islands(df, by, max_dist, width=width).groupBy(*by, "island")
    return grouped.agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def with_loci(tx: DataFrame, width: int = BIN, start: str | None = None) -> DataFrame:
    """Transcripts with ``locus``: chains of touching or overlapping spans on a chromosome; start: name of a column for where the locus begins."""
    return islands(tx, ["chrom"], order=["tid"], out="locus", width=width, start=start)


def footprint(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, bases): merged bases."""
    return clusters(df, by).groupBy(*by).agg(F.sum(F.col("e") - F.col("s")).alias("bases"))


def boundaries(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, pos): sorted distinct starts and ends are rows."""
    return df.select(*by, F.explode(F.array("s", "e")).alias("pos")).distinct()


def numbered_cuts(df: DataFrame, by: Sequence[str], width: int = BIN) -> DataFrame:
    """(by, pos, cut, ahead): distinct boundaries numbered by position within ``by``, each with the next one. Bins are scanned on their own; the
    number of boundaries before a bin and the first one behind it come from a table with a row per bin."""
    cuts = boundaries(df, by).withColumn("_bin", bin_of("pos", width))
    per = cuts.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_n"), F.min("pos").alias("_first"))
    order = W.partitionBy(*by).orderBy("_bin")
    before = F.coalesce(F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    carried = per.select(*by, "_bin", before.alias("_before"), F.lead("_first").over(order).alias("_ahead"))
    inside = W.partitionBy(*by, "_bin").orderBy("pos")
    number = F.row_number().over(inside) - 1 + F.col("_before")
    return cuts.join(carried, [*by, "_bin"]).select(*by, "pos", number.alias("cut"), F.coalesce(F.lead("pos").over(inside), "_ahead").alias("ahead"))


#: Width of a bin in which segments are cut.
CUT_BIN = 1 << 16


def cut_lists(df: DataFrame, by: Sequence[str], width: int = CUT_BIN) -> DataFrame:
    """(by, _bin, _at): the sorted distinct boundaries in each bin, followed by the first one behind it if there is any. A list has no more entries than a
    bin has positions."""
    # Without nulls, which the join drops anyway, both of its sides read the same shuffle.
    known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in (*by, "_bin")))
    ends = df.select(*by, F.explode(F.array("s", "e")).alias("pos")).withColumn("_bin", bin_of("pos", width)).where(known)
    lists = ends.groupBy(*by, "_bin").agg(F.sort_array(F.collect_set("pos")).alias("_at"))
    order = W.partitionBy(*by).orderBy("_bin")
    ahead = lists.select(*by, "_bin", F.col("_at")[0].alias("_first")).select(*by, "_bin", F.lead("_first").over(order).alias("_ahead"))
    whole = F.when(F.col("_ahead").isNull(), F.col("_at")).otherwise(F.array_append("_at", F.col("_ahead")))
    return lists.join(ahead, [*by, "_bin"]).select(*by, "_bin", whole.alias("_at"))


def binned_segments(df: DataFrame, by: Sequence[str], width: int = CUT_BIN) -> DataFrame:
    """As segments, with _bin, the bin that seg_s is in: what is grouped by (by, _bin, ..) afterwards lies in one task already.

    Rows go to the bins that they touch, once, and meet there the list of the bin's boundaries; a piece belongs to the bin where it starts.
    """
    by = list(by)
    lists = cut_lists(df, by, width)
    held = df.where("e > s").withColumn("_bin", F.explode(F.sequence(bin_of("s", width), bin_of(F.col("e") - 1, width))))
    at = lambda c: F.nullif(F.array_position("_at", F.col(c)), F.lit(0))
    # Where an end lies in another bin, all of this one's boundaries count.
    met = held.join(lists, [*by, "_bin"]).withColumn("_from", F.coalesce(at("s"), F.lit(1)).cast("int")).withColumn("_n", F.coalesce(at("e"), F.size("_at")).cast("int") - F.col("_from"))
    piece = F.arrays_zip(F.slice("_at", F.col("_from"), F.col("_n")).alias("s"), F.slice("_at", F.col("_from") + 1, F.col("_n")).alias("e"))
    return met.where("_n > 0").select(*df.columns, "_bin", F.explode(piece).alias("_x")).select(*df.columns, "_bin", F.col("_x")["s"].alias("seg_s"), F.col("_x")["e"].alias("seg_e"))


def segments(df: DataFrame, by: Sequence[str], width: int = CUT_BIN) -> DataFrame:
    """df with seg_s and seg_e: each interval cut at every boundary inside it. Empty intervals yield nothing; the pieces partition the rest. df is read
    twice: a costly one is to be staged first."""
    return binned_segments(df, by, width).drop("_bin")


def introns(exon_rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, s, e): gaps between an interval and the next of the same group; merge first where intervals may overlap."""
    ahead = F.lead("s").over(W.partitionBy(*by).orderBy("s", "e"))
    return exon_rows.select(*by, F.col("e").alias("s"), ahead.alias("e")).where("e IS NOT NULL")


def complement(df: DataFrame, sizes: DataFrame, by: str = "chrom") -> DataFrame:
    """(by, s, e): what df leaves free of [0, size); sizes has (by, size). Neighbouring islands are found bin by bin."""
    merged = clusters(df, [by]).select(by, "island", "s", "e")
    prev = merged.select(by, (F.col("island") + 1).alias("island"), F.col("e").alias("prev_e"))
    gaps = merged.join(prev, [by, "island"], "left").select(by, F.coalesce("prev_e", F.lit(0)).alias("s"), F.col("s").alias("e"))
    ends = sizes.join(merged.groupBy(by).agg(F.max("e").alias("last")), by, "left")
    tail = ends.select(by, F.coalesce("last", F.lit(0)).alias("s"), F.col("size").cast("long").alias("e"))
    return gaps.unionByName(tail).where("e > s")


def gene_sizes(exon_rows: DataFrame) -> DataFrame:
    """(chrom, locus, gene, bases): merged exonic bases; a gene over two loci has two rows."""
    return footprint(exon_rows, ["chrom", "locus", "gene"])


def promoters(tx: DataFrame, up: int, down: int, sizes: DataFrame, tss_col: str = "tss", clamp: bool = True) -> DataFrame:
    """One interval per TSS: up and down of the 5' end, within 0, the transcript's far end and the chromosome; the first transcript (by span, id) of a TSS.
    Unstranded transcripts are skipped."""
    plus = F.col("strand") == "+"
    s = F.when(plus, F.greatest(F.col("s") - up, F.lit(0))).otherwise(F.greatest(F.col("e") - down, F.col("s") if clamp else F.lit(0)))
    e = F.when(plus, F.least(F.col("s") + down, F.col("e")) if clamp else F.col("s") + down).otherwise(F.least(F.col("e") + up, F.col("size")))
    first = F.row_number().over(W.partitionBy(tss_col).orderBy("s", "e", "tid"))
    rows = tx.where("strand <> '.'").withColumn("_first", first).where("_first = 1").join(F.broadcast(sizes), "chrom")
    return rows.select("chrom", tss_col, "tid", "strand", s.alias("p_s"), F.least(e, F.col("size")).alias("p_e"))


def tss_ids(tx: DataFrame) -> DataFrame:
    """tx with tss: chromosome, strand and 5' position of stranded transcripts."""
    five = F.when(F.col("strand") == "+", F.col("s")).otherwise(F.col("e") - 1)
    return tx.withColumn("tss", F.concat_ws(":", "chrom", "strand", five.cast("string")))


def promoter_clusters(tx: DataFrame, up: int, down: int) -> DataFrame:
    """(tss, p_id, chrom, s, e): promoter windows around 5' ends, clustered regardless of strand; ids by chromosome and position."""
    five = F.when(F.col("strand") == "+", F.col("s")).otherwise(F.col("e") - 1)
    plus = F.col("strand") == "+"
    s = F.greatest(F.when(plus, five - up).otherwise(five - down), F.lit(0))
    e = F.when(plus, five + down).otherwise(five + up)
    windows = tss_ids(tx.where("strand <> '.'")).select("chrom", "tss", s.alias("s"), e.alias("e")).distinct()
    placed = islands(windows, ["chrom"], order=["tss"])
    regions = placed.groupBy("chrom", "island").agg(F.min("s").alias("p_s"), F.max("e").alias("p_e"))
    # Chromosomes are numbered one after the other: an offset per chromosome, then the island's number.
    per = regions.groupBy("chrom").agg(F.max("island").alias("n"))
    offsets = per.select("chrom", F.coalesce(F.sum("n").over(W.partitionBy().orderBy("chrom").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    named = regions.join(F.broadcast(offsets), "chrom")
    p_id = F.format_string("P%07d", F.col("island") + F.col("offset"))
    return placed.join(named, ["chrom", "island"]).select("tss", p_id.alias("p_id"), F.col("chrom").alias("p_chrom"), "p_s", "p_e")


def gene_bounds(tx: DataFrame) -> DataFrame:
    """(chrom, locus, gene, s, e): span of a gene within a locus."""
    return tx.groupBy("chrom", "locus", "gene").agg(F.min("s").alias("s"), F.max("e").alias("e"))


def moved(tx: DataFrame, places: DataFrame) -> DataFrame:
    """Transcripts moved with their gene: places has (gene, new_chrom, new_s). Exons keep their offsets."""
    start = F.min("s").over(W.partitionBy("gene"))
    shifted = tx.withColumn("_d", start).join(places, "gene").withColumn("_d", F.col("new_s") - F.col("_d"))
    return shifted.select("tid", "gene", F.col("new_chrom").alias("chrom"), "strand", (F.col("s") + F.col("_d")).alias("s"), (F.col("e") + F.col("_d")).alias("e"), F.transform("exons", lambda x: F.struct((x["s"] + F.col("_d")).alias("s"), (x["e"] + F.col("_d")).alias("e"))).alias("exons"))


def drawn(key: Column | str, below: Column, seed: int = 0) -> Column:
    """A whole number from 0 to below - 1 that depends on key and seed only: the first 60 bits of an MD5, so that any SQL engine draws it too."""
    text = F.concat_ws(":", F.lit(str(seed)), (F.col(key) if isinstance(key, str) else key).cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), below)


#: Entries of a node of the tree that random_intervals looks starts up in.
FAN = 256


def random_intervals(space: DataFrame, lengths: DataFrame, seed: int = 0) -> DataFrame:
    """(no, chrom, s, e): for each wanted length (no, length), a place in ``space`` (chrom, s, e; regions apart from one another), every start where it
    fits as likely as any other; nulls for a length that fits nowhere, is null or negative. A row for each row of lengths.

    Nothing is drawn in vain: in the order of falling widths the regions where a length fits come first, so a pass over regions and lengths
    together gives each length how many they are and how many starts they have. The wanted start is then looked up in a tree over the
    running sums, with FAN entries a node: a join for each level.
    """
    # Ranges are sampled before they are filled, and lengths are read again: both tables are written first.
    space, lengths = stage(space.select("chrom", "s", "e"), "space"), stage(lengths.select("no", "length"), "lengths")
    width = (F.col("e") - F.col("s")).cast("long")
    regions = space.select("chrom", "s", "e", width.alias("_w"), F.lit(0).alias("_kind"), F.lit(1).cast("long").alias("_one"), (width + 1).alias("_starts")).where("_w >= 0")
    none = lambda c: F.lit(None).cast(space.schema[c].dataType).alias(c)
    wanted = lengths.where("length >= 0").select(*map(none, ("chrom", "s", "e")), F.col("length").cast("long").alias("_w"), F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_one"), F.lit(0).cast("long").alias("_starts")).distinct()
    both = regions.unionByName(wanted).withColumn("_down", -F.col("_w"))
    summed = stage(running(both, [], ["_down", "_kind", "chrom", "s", "e"], {"k": "_one", "c": "_starts"}), "running-starts")
    # Of a region: regions and starts before it; of a length: the regions where it fits, and their widths.
    fits = summed.where("_kind = 1").select(F.col("_w").alias("_l"), F.col("k").alias("m"), (F.col("c") - F.col("k") * F.col("_w")).alias("total"))
    asked = lengths.select("no", F.col("length").cast("long").alias("_l")).join(fits, "_l", "left")
    placed = asked.where("total > 0").withColumn("r", drawn("no", F.col("total"), seed)).withColumn("at", F.lit(0).cast("long"))
    nodes = summed.where("_kind = 0").select("k", "c", "chrom", "s")
    parts = int(space.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    depth, n = 0, nodes.count()
    while FAN ** (depth + 1) < n:
        depth += 1
    for level in range(depth, -1, -1):
        step = FAN**level
        entries = nodes.where(F.col("k") % step == 0).groupBy(F.floor(F.col("k") / (step * FAN)).cast("long").alias("at")).agg(F.array_sort(F.collect_list(F.struct("k", "c", "chrom", "s"))).alias("_entries"))
        # The number is given, as a look-up costs more than its row weighs: rows aren't to be put together in fewer tasks.
        met = placed.repartition(parts, "no").join(F.broadcast(entries), "at") if level == depth else placed.repartition(parts, "at").join(entries.repartition(parts, "at"), "at")
        # The entries that qualify come first, and the first one does: their last is found by halves.
        ok = lambda x: (x["k"] < F.col("m")) & (x["c"] - x["k"] * F.col("_l") <= F.col("r"))
        halves = F.array(*(F.lit(FAN >> i) for i in range(1, FAN.bit_length())))
        last = F.get("_entries", F.aggregate(halves, F.lit(0), lambda at, by: F.when(ok(F.get("_entries", at + by)), at + by).otherwise(at)))
        placed = met.withColumn("_hit", last).drop("_entries").withColumn("at", F.floor(F.col("_hit.k") / step).cast("long"))
    start = F.col("_hit.s") + F.col("r") - (F.col("_hit.c") - F.col("_hit.k") * F.col("_l"))
    found = placed.select("no", F.col("_hit.chrom").alias("chrom"), start.alias("s"), (start + F.col("_l")).alias("e"))
    return found.unionByName(asked.where("total IS NULL OR total <= 0").select("no", *map(none, ("chrom", "s", "e"))))


def shuffled_places(genes: DataFrame, sizes: DataFrame, seed: int = 0) -> DataFrame:
    """(gene, new_chrom, new_s): a seeded place for each gene (gene, span) on a chromosome (chrom, size) in which it fits, every start as likely as
    any other; nulls where it fits nowhere."""
    whole = sizes.select("chrom", F.lit(0).cast("long").alias("s"), F.col("size").cast("long").alias("e"))
    places = random_intervals(whole, genes.select(F.col("gene").alias("no"), F.col("span").alias("length")), seed)
    return places.select(F.col("no").alias("gene"), F.col("chrom").alias("new_chrom"), F.col("s").alias("new_s"))


def to_genome(exon_rows: DataFrame, points: DataFrame) -> DataFrame:
    """(tid, pos, g_pos): transcript offsets to genome positions along the strand; offsets past the end clamp to the last base.

    exon_rows: tid, strand, s, e; points: tid, pos.
    """
    plus = F.col("strand") != "-"
    order = W.partitionBy("tid").orderBy(F.when(plus, F.col("s")).otherwise(-F.col("e")))
    laid = exon_rows.withColumn("t_e", F.sum(F.col("e") - F.col("s")).over(order)).withColumn("t_s", F.col("t_e") - (F.col("e") - F.col("s")))
    laid = laid.withColumn("t_len", F.sum(F.col("e") - F.col("s")).over(W.partitionBy("tid")))
    at = F.least(F.col("pos"), F.col("t_len") - 1)
    hit = points.join(laid, "tid").where((at >= F.col("t_s")) & (at < F.col("t_e")))
    return hit.select("tid", "pos", F.when(plus, F.col("s") + at - F.col("t_s")).otherwise(F.col("e") - 1 - (at - F.col("t_s"))).alias("g_pos"))
