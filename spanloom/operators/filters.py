"""Projections, filters and identifiers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.sources.stages import stage

#: Names of the main chromosomes in two conventions.
CHROMS = {f"chr{x}": str(x) for x in [*range(1, 23), "X", "Y"]} | {"chrM": "MT"}


def by_attributes(df: DataFrame, tests: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rows of a table with an attrs map that pass all tests (key, op, value), op = == ! or !=; a missing attribute equals nothing, so != holds."""
    ops = {"=": True, "==": True, "!": False, "!=": False}
    checks = [(F.col("attrs")[k].eqNullSafe(F.lit(v)) == ops[op]) for k, op, v in tests]
    return df.where(reduce(lambda a, b: a & b, checks, F.lit(True)))


def in_region(df: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    return df.where((F.col("chrom") == chrom) & (F.col("s") < end) & (F.col("e") > start))


def on_chroms(df: DataFrame, chroms: Sequence[str]) -> DataFrame:
    return df.where(F.col("chrom").isin(list(chroms)))


def clip_terminal_exons(tx: DataFrame, least: int = 15) -> DataFrame:
    """tx (exons array) with a terminal exon shorter than ``least`` cut off at each end, one per end, while more than one exon is left; adds clipped."""
    size = lambda x: x["e"] - x["s"]
    first = (F.size("exons") > 1) & (size(F.col("exons")[0]) < least)
    cut = tx.withColumn("_n", F.size("exons")).withColumn("exons", F.when(first, F.slice("exons", 2, 1 << 30)).otherwise(F.col("exons")))
    last = (F.size("exons") > 1) & (size(F.element_at("exons", -1)) < least)
    cut = cut.withColumn("exons", F.when(last, F.slice("exons", F.lit(1), F.size("exons") - 1)).otherwise(F.col("exons")))
    length = F.aggregate("exons", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])
    return cut.withColumn("clipped", F.col("_n") > F.size("exons")).withColumn("length", length).withColumn("n_exons", F.size("exons")).withColumn("s", F.col("exons")[0]["s"]).withColumn("e", F.element_at("exons", -1)["e"]).drop("_n")


def aggregate_filter(tx: DataFrame, min_length: int = 250, min_exon: int = 15) -> DataFrame:
    """Clipped transcripts with too_short (length at most min_length)."""
    return clip_terminal_exons(tx, min_exon).withColumn("too_short", F.col("length") <= min_length)


def assembly_status(tx: DataFrame, min_length: int = 250, guided: bool = False, score: str = "score") -> DataFrame:
    """tx with status: why a transcript is left out of assembly, or ok. Tests in order; here the length must be at least min_length."""
    ref = F.lit(False) if guided else F.col("ref")
    status = (
        F.when(ref, "reference")
        .when(F.col("n_exons") == 0, "no_exons")
        .when((F.col("strand") == ".") & (F.col("n_exons") > 1), "unstranded")
        .when(F.col("length") < min_length, "short")
        .when(F.nanvl(F.coalesce(F.col(score).cast("double"), F.lit(0.0)), F.lit(0.0)) < 1e-10, "no_score")
        .otherwise("ok")
    )
    return tx.withColumn("status", status)


def csv_overlaps(csv: Column, values: Sequence[str]) -> Column:
    """Whether a comma-separated text holds any of the values."""
    return F.coalesce(F.arrays_overlap(F.split(csv, ","), F.array(*map(F.lit, values))), F.lit(False))


def noncoding(tx: DataFrame, categories: Sequence[str], excluded: Sequence[str], min_length: int, min_exons: int, min_distance: int) -> DataFrame:
    """Long transcripts of the wanted categories, without any excluded source, with enough exons, far enough from the nearest gene (or none)."""
    far = F.col("distance").isNull() | (F.abs("distance") >= min_distance)
    return tx.where(F.col("category").isin(list(categories)) & ~csv_overlaps(F.col("sources"), excluded) & (F.col("length") >= min_length) & (F.col("n_exons") >= min_exons) & far)


def set_attr(df: DataFrame, key: str, value: str, force: bool = False) -> DataFrame:
    """attrs with key set. An existing key is an error unless forced; the error is raised when such a row is read."""
    plain = F.map_concat(F.map_filter("attrs", lambda k, v: k != key), F.create_map(F.lit(key), F.lit(value)))
    if not force:
        plain = F.when(F.map_contains_key("attrs", key), F.raise_error(F.lit(f"attribute {key} exists"))).otherwise(plain)
    return df.withColumn("attrs", plain)


def drop_attr(df: DataFrame, key: str) -> DataFrame:
    """attrs without key; a missing key is fine."""
    return df.withColumn("attrs", F.map_filter("attrs", lambda k, v: k != key))


def set_source(df: DataFrame, source: str) -> DataFrame:
    return df.withColumn("source", F.lit(source))


def transcript_rows(features: DataFrame) -> DataFrame:
    """Transcript feature rows made from exon rows, together with all exons: span from the first start to the last end by start."""
    exon = features.where("feature_type = 'exon'")
    whole = exon.groupBy("tid").agg(F.min("chrom").alias("chrom"), F.min("strand").alias("strand"), F.min("s").alias("s"), F.max_by("e", F.struct("s", "e")).alias("e"))
    return whole.select("tid", "chrom", "strand", "s", "e", F.lit("transcript").alias("feature_type")).unionByName(exon.select("tid", "chrom", "strand", "s", "e", "feature_type"))


def explode_transcripts(tx: DataFrame) -> DataFrame:
    """Transcript rows followed by their exon rows, exon_number from 0 (null on transcript rows)."""
    cols = ["tid", "chrom", "strand"]
    exon = tx.select(*cols, F.posexplode("exons").alias("exon_number", "x")).select(*cols, F.lit("exon").alias("feature_type"), F.col("x.s").alias("s"), F.col("x.e").alias("e"), "exon_number")
    return tx.select(*cols, F.lit("transcript").alias("feature_type"), "s", "e", F.lit(None).cast("int").alias("exon_number")).unionByName(exon)


def renumber(df: DataFrame, key: str, order: Sequence[str], prefix: str, out: str, width: int = 0) -> DataFrame:
    """df with ``out``: keys numbered by first appearance. The table of keys, not of rows, is sorted: firsts are range-partitioned, counted
    per range, and numbered by range offset and rank within."""
    firsts = df.groupBy(key).agg(F.min(F.struct(*order)).alias("_first"))
    name = lambda n: F.format_string(f"{prefix}%0{width}d" if width else f"{prefix}%d", n)
    return df.join(global_rank(firsts, ["_first", key], "_no").select(key, name(F.col("_no")).alias(out)), key)


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """df with, for each (out, column) of sums, the column's sum over the rows of the same group that stand before in order.

    No window holds a group: rows are range-partitioned by group and order and written with their range's number, so that inner sums and
    offsets speak of the same ranges whatever is computed again; offsets are sums over ranges. order must be total within a group.
    """
    by = list(by)
    ranged = stage(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per = ranged.groupBy(*by, "_part").agg(*(F.sum(c).alias(f"_o{k}") for k, c in enumerate(sums.values())))
    over = W.partitionBy(*by).orderBy("_part")
    keys = [F.col(c).alias(f"_by{k}") for k, c in enumerate(by)]
    offsets = per.select(F.col("_part").alias("_p"), *keys, *(before(f"_o{k}", over).alias(f"_o{k}") for k in range(len(sums))))
    same = F.col("_part") == F.col("_p")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{k}"))
    inside = W.partitionBy("_part", *by).orderBy(*order)
    out = ranged.select("*", *(before(c, inside).alias(f"_i{k}") for k, c in enumerate(sums.values()))).join(offsets, same)
    return out.select(*df.columns, *((F.col(f"_i{k}") + F.col(f"_o{k}")).alias(name) for k, name in enumerate(sums)))


def global_rank(df: DataFrame, order: Sequence[str], out: str, start: int = 1) -> DataFrame:
    """df with its position in the global order, without a single-partition window; order must be total."""
    ranked = running(df.withColumn("_one", F.lit(1).cast("long")), [], order, {out: "_one"}).drop("_one")
    return ranked.withColumn(out, F.col(out) + start)


def tag_tests(tx: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """tx with tst: reference transcripts of genes drawn with probability ``fraction``, by an MD5 of gene and seed. A null gene is drawn
    as an empty one."""
    text = F.concat_ws(":", F.lit(str(seed)), F.col("gene"))
    part = F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(1_000_000))
    return tx.withColumn("tst", F.col("ref") & (part < fraction * 1_000_000))


def tag_test_list(tx: DataFrame, genes: DataFrame) -> DataFrame:
    """tx with tst: reference transcripts of the listed genes."""
    listed = genes.select("gene").distinct().withColumn("_listed", F.lit(True))
    return tx.join(listed, "gene", "left").withColumn("tst", F.col("ref") & F.coalesce("_listed", F.lit(False))).drop("_listed")


def translate_chroms(df: DataFrame, to_plain: bool = True, names: dict[str, str] | None = None) -> DataFrame:
    """Chromosome names in the other convention; rows whose name has no translation are dropped."""
    names = names or CHROMS
    pairs = names if to_plain else {v: k for k, v in names.items()}
    table = F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))
    return df.withColumn("chrom", F.try_element_at(table, F.col("chrom"))).where("chrom IS NOT NULL")


def merge_strand(strands: Column) -> Column:
    """The strand of a group (array of strands): the one stranded value there is, '.' if none or both."""
    known = F.array_distinct(F.filter(strands, lambda x: x != "."))
    return F.when(F.size(known) == 1, known[0]).otherwise(".")


def strands_agree(a: Column, b: Column) -> Column:
    """Unstranded matches anything."""
    return (a == b) | (a == ".") | (b == ".")
