"""Aggregates, ranks and summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.operators.filters import running
from spanloom.sources.stages import stage

#: Quantiles of the library reports, in percent.
PERCENTS = (0, 1, 5, 10, 25, 50, 75, 90, 95, 99, 100)


def _below(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Per group and distinct value: _n rows with it, _below rows under it, _all rows of the group; no task has to hold a group."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    below = running(counts, by, [value], {"_below": "_n"})
    sizes = below.groupBy(*by).agg(F.sum("_n").alias("_all")).select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), "_all")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)), F.lit(True))
    return below.join(sizes, same).select(*by, value, "_n", "_below", "_all")


def left_ecdf_rank(df: DataFrame, by: str, value: str, out: str = "pct") -> DataFrame:
    """df with 100 * (rows of the group strictly below) / (rows of the group).

    Ranks come from the distinct values of a group and how often each occurs, so ties, however many, are counted before the sort.
    """
    ranks = _below(df, [by], value).select(F.col(by).alias("_by"), F.col(value).alias("_value"), (100.0 * F.col("_below") / F.col("_all")).alias(out))
    return df.join(ranks, F.col(by).eqNullSafe(F.col("_by")) & F.col(value).eqNullSafe(F.col("_value"))).drop("_by", "_value")


def quantiles(df: DataFrame, by: Sequence[str], value: str, percents: Sequence[float] = PERCENTS, prefix: str = "q", where: Column | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per percent; null for an empty group; null values don't count. The two data points
    around each position are picked from distinct values and how many rows lie below, so no task holds a group's values."""
    by, picked = list(by), F.col(value) if where is None else F.when(where, F.col(value))
    values = df.select(*by, picked.cast("double").alias("_v")).where("_v IS NOT NULL")
    held = lambda at: (F.col("_below") <= at) & (at < F.col("_below") + F.col("_n"))
    aggs = []
    for i, p in enumerate(percents):
        at = (F.col("_all") - 1) * F.lit(p / 100)
        aggs += [F.max(F.when(held(f(at)), F.col("_v"))).alias(f"_{k}{i}") for k, f in (("a", F.floor), ("b", F.ceil))]
    found = _below(values, by, "_v").groupBy(*by).agg(F.first("_all").alias("_all"), *aggs)
    keyed = found.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), *(c for c in found.columns if c not in by))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)), F.lit(True))
    out = df.select(*by).distinct().join(keyed, same, "left")

    def between(i: int, p: float) -> Column:
        at = (F.col("_all") - 1) * F.lit(p / 100)
        low, high = F.col(f"_a{i}"), F.col(f"_b{i}")
        return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    return out.select(*by, *(between(i, p).alias(f"{prefix}{p:g}") for i, p in enumerate(percents)))


def discrete_quantile(df: DataFrame, by: Sequence[str], value: str, percent: float, side: str = "lower") -> DataFrame:
    """The data point below (lower) or above (higher) the interpolated position (n - 1) * percent / 100."""
    at = (F.col("_all") - 1) * percent / 100
    wanted = F.floor(at) if side == "lower" else F.ceil(at)
    held = (F.col("_below") <= wanted) & (wanted < F.col("_below") + F.col("_n"))
    return _below(df, by, value).where(held).select(*by, F.col(value).alias(side))


def ecdf_band(df: DataFrame, by: str, value: str, alpha: float = 0.05) -> DataFrame:
    """(by, value, ecdf, low, high): right-continuous ECDF at each distinct value with its DKW band, clipped to [0, 1]."""
    counts, n = _below(df, [by], value), F.col("_all")
    y = (F.col("_below") + F.col("_n")) / n
    eps = F.sqrt(F.log(F.lit(2 / alpha)) / (2 * n))
    return counts.select(by, value, y.alias("ecdf"), F.greatest(y - eps, F.lit(0.0)).alias("low"), F.least(y + eps, F.lit(1.0)).alias("high"))


def step_lookup(points: DataFrame, steps: DataFrame, x: str, y: str, default: float = 0.0, side: str = "right") -> DataFrame:
    """points with y of the step function steps (x, y): the last step at or before x (right), or strictly before it (left); of steps at one x the
    one with the greatest y. The default before the first step and where x is null.

    Distinct positions of both tables are cut in ranges and written with their range's number; each range is scanned on its own, and what the
    ranges before it end with is carried over.
    """
    first, second = (0, 1) if side == "right" else (1, 0)
    edges = steps.where(F.col(x).isNotNull()).groupBy(F.col(x).cast("double").alias("_x")).agg(F.max(y).cast("double").alias("_y"))
    asks = points.where(F.col(x).isNotNull()).select(F.col(x).cast("double").alias("_x")).distinct()
    both = edges.select("_x", F.lit(first).alias("_k"), "_y").unionByName(asks.select("_x", F.lit(second).alias("_k"), F.lit(None).cast("double").alias("_y")))
    ranged = stage(both.repartitionByRange("_x", "_k").withColumn("_part", F.spark_partition_id()), "steps")
    last = ranged.groupBy("_part").agg(F.max(F.when(F.col("_y").isNotNull(), F.struct("_x", "_y"))).alias("_c"))
    carry = last.select("_part", F.max("_c").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)).alias("_c"))  # a row a range
    near = F.last("_y", ignorenulls=True).over(W.partitionBy("_part").orderBy("_x", "_k").rowsBetween(W.unboundedPreceding, 0))
    found = ranged.withColumn("_v", near).where(F.col("_k") == second).join(F.broadcast(carry), "_part").select("_x", F.coalesce("_v", "_c._y").alias("_v"))
    met = points.join(found, F.col(x).cast("double") == F.col("_x"), "left")
    return met.select(*points.columns, F.coalesce("_v", F.lit(default)).alias(y))


def library_stats(tx: DataFrame, percents: Sequence[float] = PERCENTS) -> DataFrame:
    """Per library: passed, failed, too_short, too_short_exon, and score quantiles of what failed and passed. tx has too_short and clipped."""
    bad = F.col("too_short")
    one = tx.groupBy("lib").agg(F.count_if(~bad).alias("passed"), F.count_if(bad).alias("failed"), F.count_if(bad).alias("too_short"), F.count_if("clipped").alias("too_short_exon"))
    split = quantiles(tx.withColumn("_bad", bad), ["lib", "_bad"], "score", percents)
    half = lambda is_bad, k: split.where(F.col("_bad") == is_bad).select(F.col("lib").alias("_lib"), *(F.col(f"q{p:g}").alias(f"{k}_q{p:g}") for p in percents))
    for is_bad, k in ((True, "failed"), (False, "passed")):
        one = one.join(half(is_bad, k), F.col("lib").eqNullSafe(F.col("_lib")), "left").drop("_lib")
    return one


def category_stats(tx: DataFrame, names: Sequence[str]) -> DataFrame:
    """Per library and category (numbers 0 to len(names) - 1; tests count as 0): count and score sum, one column each."""
    category = F.when(F.col("tst"), 0).otherwise(F.col("category"))
    aggs = [f(F.when(category == k, v)).alias(f"{n}_{what}") for k, n in enumerate(names) for f, v, what in ((F.count, F.lit(1), "count"), (F.sum, F.col("score"), "signal"))]
    return tx.groupBy("lib").agg(*aggs).na.fill(0)


def distinct_by(df: DataFrame, by: str, key: str) -> DataFrame:
    return df.groupBy(by).agg(F.countDistinct(key).alias("n"))


def feature_stats(exon_rows: DataFrame, intron_rows: DataFrame) -> DataFrame:
    """One row: distinct genes, transcripts, exons and introns (by chromosome, strand and both ends)."""
    place = ("chrom", "strand", "s", "e")
    # Two-step distinct counts: no group of everything is gathered in one task.
    n = lambda df, *cols: df.select(*cols).distinct().agg(F.count(F.lit(1)).alias("n"))
    parts = [("genes", n(exon_rows, "gene")), ("transcripts", n(exon_rows, "tid")), ("exons", n(exon_rows, *place)), ("introns", n(intron_rows, *place))]
    rows = None
    for name, df in parts:
        one = df.select(F.lit(name).alias("what"), "n")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def weighted_means(nodes: DataFrame, by: str, values: Sequence[str]) -> DataFrame:
    """Length-weighted means over (by, s, e, values)."""
    length = F.col("e") - F.col("s")
    return nodes.groupBy(by).agg(*((F.sum(F.col(v) * length) / F.sum(length)).alias(f"mean_{v}") for v in values))


def csv_values(csv: str) -> Column:
    """Aggregate: distinct values of comma-separated texts, sorted, joined again; NA without any."""
    values = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split(csv, ",")))))
    return F.when(F.size(values) == 0, "NA").otherwise(F.array_join(values, ","))


def expression_matrix(long: DataFrame, columns: Sequence[str], row: str = "tid", column: str = "lib", value: str = "score") -> DataFrame:
    """Pivot to one column per listed library; missing is null."""
    return long.groupBy(row).pivot(column, list(columns)).agg(F.first(value, ignorenulls=True))


def fpkm_to_counts(fpkm: Column, length: Column, mass: Column) -> Column:
    """Reads from FPKM, rounded half to even at two decimals."""
    return F.bround(fpkm * (length / 1e3) * (mass / 1e6), 2)


def row_summary(long: DataFrame, row: str, value: str) -> DataFrame:
    """Mean and quantiles of each row of a long matrix; a row has a value per library, so its values fit a buffer."""
    at = F.array(*(F.lit(p / 100) for p in PERCENTS))
    one = long.groupBy(row).agg(F.avg(value).alias("mean"), F.percentile(value, at).alias("_q"))
    return one.select(row, F.round("mean", 4).alias("mean"), *(F.round(F.col("_q")[i], 4).alias(f"p{p:g}") for i, p in enumerate(PERCENTS)))


def matrix_subset(long: DataFrame, rows: DataFrame, columns: DataFrame, row: str = "tid", column: str = "lib") -> DataFrame:
    return long.join(rows.select(row).distinct(), row, "left_semi").join(columns.select(column).distinct(), column, "left_semi")


def track_means(features: DataFrame, track: DataFrame, least: float) -> DataFrame:
    """Per feature (tid): mean of the track over covered bases, the part of them at or above ``least``, and how many are covered. track: chrom, s,
    e, value (no overlaps, null where undefined); works on segments, never on single bases."""
    from spanloom.operators.joins import overlap_join

    hit = overlap_join(features.select("chrom", "tid", "s", "e"), track.where("value IS NOT NULL AND NOT isnan(value)").select("chrom", "s", "e", "value"), ["chrom"])
    n = F.least("e", "b_e") - F.greatest("s", "b_s")
    return hit.groupBy("tid").agg((F.sum(F.col("b_value") * n) / F.sum(n)).alias("mean"), (F.sum(F.when(F.col("b_value") >= least, n).otherwise(0)) / F.sum(n)).alias("frac"), F.sum(n).alias("n_covered"))


def best_window(bases: DataFrame, by: str, pos: str, value: str, width: int) -> DataFrame:
    """(by, best): greatest mean over ``width`` consecutive positions that all have a value; null where there is none."""
    w = W.partitionBy(by).orderBy(pos).rowsBetween(1 - width, 0)
    mean = F.when((F.count(value).over(w) == width) & (F.max(pos).over(w) - F.min(pos).over(w) == width - 1), F.avg(value).over(w))
    return bases.withColumn("_m", mean).groupBy(by).agg(F.max("_m").alias("best"))


def best_stretch_window(track: DataFrame, by: str, width: int) -> DataFrame:
    """(by, best): greatest mean over ``width`` consecutive positions that all have a value, for a track of stretches (by, s, e, value; without
    overlaps, null or NaN where undefined); null where there is none. A row a stretch, however long it is.

    The mean of a sliding window is linear between the places where one of its ends passes a stretch's edge, so the best window begins or
    ends at an edge. The sum up to its other end is that up to the stretch which holds it, and a part of this stretch.
    """
    order = W.partitionBy(by).orderBy("s")
    held = track.where("value IS NOT NULL AND NOT isnan(value) AND e > s").select(by, "s", "e", F.col("value").cast("double").alias("value"))
    summed = held.withColumn("_sum", F.sum(F.col("value") * (F.col("e") - F.col("s"))).over(order) - F.col("value") * (F.col("e") - F.col("s")))
    runs = summed.withColumn("_new", F.coalesce((F.col("s") != F.lag("e").over(order)).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(order))
    whole = W.partitionBy(by, "_run")
    runs = runs.withColumn("_from", F.min("s").over(whole)).withColumn("_to", F.max("e").over(whole))
    begin = F.struct((F.col("s") + width).alias("pos"), (-F.col("_sum")).alias("known"), F.lit(1).alias("sign"), (F.col("s") + width <= F.col("_to")).alias("ok"))
    close = F.struct((F.col("e") - width).alias("pos"), (F.col("_sum") + F.col("value") * (F.col("e") - F.col("s"))).alias("known"), F.lit(-1).alias("sign"), (F.col("e") - width >= F.col("_from")).alias("ok"))
    asked = runs.select(by, F.explode(F.array(begin, close)).alias("x")).where("x.ok").select(by, "x.pos", F.lit(1).alias("kind"), "x.known", "x.sign", F.lit(None).cast("struct<sum:double,s:bigint,value:double>").alias("at"))
    edges = runs.select(by, F.col("s").alias("pos"), F.lit(0).alias("kind"), F.lit(None).cast("double").alias("known"), F.lit(None).cast("int").alias("sign"), F.struct(F.col("_sum").alias("sum"), F.col("s").cast("long").alias("s"), "value").alias("at"))
    last = F.last("at", ignorenulls=True).over(W.partitionBy(by).orderBy("pos", "kind").rowsBetween(W.unboundedPreceding, 0))
    met = edges.unionByName(asked).withColumn("_at", last).where("kind = 1")
    mean = (F.col("known") + F.col("sign") * (F.col("_at.sum") + F.col("_at.value") * (F.col("pos") - F.col("_at.s")))) / width
    best = met.groupBy(by).agg(F.max(mean).alias("best"))
    return track.select(by).distinct().join(best, by, "left")


def histogram_cdf(df: DataFrame, by: str, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(by, bin, n, cdf): values clipped into [low, high]; bins from 0; empty bins are left out."""
    clipped = F.least(F.greatest(F.col(value), F.lit(low)), F.lit(high))
    bin_no = F.least(F.floor((clipped - low) / ((high - low) / bins)), F.lit(bins - 1))
    counts = df.select(by, bin_no.alias("bin")).groupBy(by, "bin").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("cdf", F.sum("n").over(W.partitionBy(by).orderBy("bin")) / F.sum("n").over(W.partitionBy(by)))


def confusion(df: DataFrame, score: str, label: str, cutoffs: int = 1000) -> DataFrame:
    """(cutoff, tp, fp, fn, tn, sens, spec, prec, f, balacc) for cutoffs 0, 1/cutoffs, .. 1; predicted when score >= cutoff.

    Scores are counted by the last cutoff that they reach, then summed from above: no row meets all cutoffs.
    """
    spark = df.sparkSession
    reach = F.floor(F.least(F.greatest(F.col(score), F.lit(-1.0 / cutoffs)), F.lit(1.0)) * cutoffs + 1e-9).cast("int")
    per = df.select(reach.alias("k"), F.col(label).alias("y")).groupBy("k").agg(F.count_if("y").alias("p"), F.count_if(~F.col("y")).alias("n"))
    grid = spark.range(-1, cutoffs + 1).select(F.col("id").cast("int").alias("k")).join(per, "k", "left").na.fill(0)
    up = W.partitionBy().orderBy(F.desc("k"))  # cutoffs + 2 rows
    every = W.partitionBy()
    m = grid.select("k", F.sum("p").over(up).alias("tp"), F.sum("n").over(up).alias("fp"), F.sum("p").over(every).alias("_p"), F.sum("n").over(every).alias("_n")).where("k >= 0")
    m = m.select((F.col("k") / cutoffs).alias("cutoff"), "tp", "fp", (F.col("_p") - F.col("tp")).alias("fn"), (F.col("_n") - F.col("fp")).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    m = m.withColumn("sens", ratio(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn("spec", ratio(F.col("tn"), F.col("tn") + F.col("fp"))).withColumn("prec", ratio(F.col("tp"), F.col("tp") + F.col("fp")))
    return m.withColumn("f", ratio(2 * F.col("prec") * F.col("sens"), F.col("prec") + F.col("sens"))).withColumn("balacc", (F.col("sens") + F.col("spec")) / 2)


def auc(df: DataFrame, by: str, score: str, label: str) -> DataFrame:
    """(by, auc): Mann-Whitney with average ranks; null where a class is empty. Ranks come from distinct scores and their counts."""
    counts = df.groupBy(by, score).agg(F.count_if(label).alias("p"), F.count(F.lit(1)).alias("n"))
    ranks = running(counts, [by], [score], {"_below": "n"}).withColumn("_rank", F.col("_below") + (F.col("n") + 1) / 2)
    s = ranks.groupBy(by).agg(F.sum(F.col("_rank") * F.col("p")).alias("r"), F.sum("p").alias("p"), F.sum(F.col("n") - F.col("p")).alias("q"))
    return s.select(by, F.when((F.col("p") > 0) & (F.col("q") > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).alias("auc"))


def best_cutoff(table: DataFrame, metric: str = "balacc", last: bool = False, least: dict[str, float] | None = None) -> DataFrame:
    """One row: the cutoff with the greatest metric, the first such (by cutoff) or the last; only cutoffs whose metrics reach ``least``."""
    ok = table
    for k, v in (least or {}).items():
        ok = ok.where(F.col(k) >= v)
    order = F.col("cutoff") if last else -F.col("cutoff")
    return ok.agg(F.max_by(F.struct("cutoff", F.col(metric).alias("value")), F.struct(F.col(metric), order)).alias("b")).select("b.cutoff", "b.value")


def best_row(df: DataFrame, by: str, value: str, ties: Sequence[str]) -> DataFrame:
    """The row of each group with the greatest value; texts that are no numbers (None, NA, nan) come last."""
    number = F.col(value).try_cast("double")
    number = F.when(F.isnan(number), None).otherwise(number)
    rank = F.row_number().over(W.partitionBy(by).orderBy(number.desc_nulls_last(), *ties))
    return df.withColumn("_r", rank).where("_r = 1").drop("_r")
