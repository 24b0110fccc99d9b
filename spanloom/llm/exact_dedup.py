"""Operator 10: exact deduplication through a log-structured merge index.

Slices of the input are memtables: each is aggregated by digest and flushed as a sorted run of level 0, with a filter of its digests. Before a
run joins the index its digests are looked up there: each older run's filter lets through what it may hold, and only that is looked for in
the run. A level that holds ``FANOUT`` runs is compacted into one run of the next level, which keeps the extreme identifier and the
number of rows of each digest. Digests found twice are hits, and hits are verified by their bytes: the smallest and the largest text of a
digest must be the same. Digests that fail are regrouped by the text itself, so a collision never joins two texts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import MOST_BITS, bits_for, discard, key_bits, may_hold, new_path, stage, table
from spanloom.operators.joins import lookup_join

#: Runs of a level that are merged into one of the next; memtables that a table is cut into.
FANOUT, MEMTABLES = 3, 4


@dataclass
class Run:
    """Sorted entries (digest, keep_id, n), one per digest, and the filter of their digests."""

    entries: DataFrame
    bits: int
    filter_rows: DataFrame


@dataclass
class DigestIndex:
    """Runs by level in the shared folder. ``keep`` says which identifier of a digest survives compaction: min or max."""

    spark: SparkSession
    keep: str = "min"
    fanout: int = FANOUT
    levels: list[list[Run]] = field(default_factory=list)
    merged: list[Run] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.extreme = {"min": F.min, "max": F.max}[self.keep]

    def _written(self, entries: DataFrame, level: int) -> Run:
        entries = stage(entries.repartition("digest").sortWithinPartitions("digest"), f"digest-run-level{level}")
        bits = bits_for(entries.count())
        return Run(entries, bits, stage(key_bits(entries, "digest", bits), "digest-filter"))

    def _add(self, run: Run, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self.merged += full
            self._add(self._written(self._merge(full), level + 1), level + 1)

    def _merge(self, runs: list[Run]) -> DataFrame:
        both = runs[0].entries
        for r in runs[1:]:
            both = both.unionByName(r.entries)
        return both.groupBy("digest").agg(self.extreme("keep_id").alias("keep_id"), F.sum("n").alias("n"))

    def lookup(self, digests: DataFrame) -> DataFrame:
        """Those of digests (digest, distinct) that the index holds."""
        found = digests.limit(0)
        for run in (r for level in self.levels for r in level):
            likely = may_hold(digests, F.col("digest"), run.filter_rows, run.bits, small=run.bits < MOST_BITS)
            # An inner join (a run holds a digest once): a semi join would be moved below the filter's join.
            found = found.unionByName(likely.join(run.entries.select("digest"), "digest"))
        return found.distinct()

    def flush(self, signatures: DataFrame) -> DataFrame:
        """Add a memtable (id, digest); returns its hits: digests that it holds twice, or that the index had. They can be read until ``clean``."""
        grouped = signatures.groupBy("digest").agg(self.extreme("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        run = self._written(grouped, 0)
        hits = run.entries.where("n > 1").select("digest").unionByName(self.lookup(run.entries.select("digest")))
        self._add(run, 0)
        return hits

    def compact(self) -> DataFrame:
        """Merge all runs into one of the last level; returns its entries (digest, keep_id, n)."""
        runs = [r for level in self.levels for r in level]
        if len(runs) > 1:
            last = len(self.levels)
            self.merged += runs
            self.levels = [[] for _ in range(last)] + [[self._written(self._merge(runs), last)]]
        return next(r for level in self.levels for r in level).entries

    def clean(self) -> None:
        """Delete the runs that were merged into others."""
        for old in self.merged:
            discard(old.entries, old.filter_rows)
        self.merged = []


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_groups(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", digest=sha256, memtables: int = MEMTABLES) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, digest, text_sha256.

    Texts are equal when all their bytes are; a null text is the empty text. Of equal texts the smallest (keep="min") or largest
    identifier stays; identifiers are of any type that has an order. Rows that repeat an identifier with its text are one document listed
    twice: each counts in group_size, and all of them carry the document's verdict. Null identifiers lose to any other; a group of null
    identifiers alone keeps none of them (kept is false, keep_id null). An empty table gives an empty result. Other columns are ignored.

    Only digests are shuffled for all rows; texts move for the hits, after a partial min and max.
    """
    spark = rows.sparkSession
    source = rows.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("digest", digest(F.col("text")))
    signatures = source.select("id", "digest", sha256(F.col("text")).alias("text_sha256"))
    signatures = stage(signatures.withColumn("memtable", F.pmod(F.xxhash64("id"), F.lit(memtables)).cast("int")), "signatures")
    index = DigestIndex(spark, keep)
    hits = None
    for k in range(memtables):
        more = index.flush(signatures.where(F.col("memtable") == k).select("id", "digest"))
        hits = more if hits is None else hits.unionByName(more)
    entries = index.compact()
    hits = stage(hits.distinct(), "digest-hits")
    index.clean()
    bits = bits_for(hits.count())
    doubtful = may_hold(source, F.col("digest"), key_bits(hits, "digest", bits), bits)
    ends = doubtful.groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b"))
    unequal = stage(ends.where("a <> b").select("digest"), "unequal")
    collide = not unequal.isEmpty()
    good = stage(entries.join(unequal, "digest", "left_anti"), "digest-entries") if collide else entries
    good = good.withColumn("group_size", F.col("n"))
    out = lookup_join(signatures.drop("memtable"), good, "digest", "n", "inner").select("id", "keep_id", "group_size", "digest", "text_sha256")
    if collide:
        apart = source.join(unequal, "digest")
        groups = apart.groupBy("digest", "text").agg(index.extreme("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        again = apart.join(groups, ["digest", "text"]).select("id", "keep_id", "group_size", "digest", sha256(F.col("text")).alias("text_sha256"))
        out = out.unionByName(again)
    kept = F.coalesce(F.col("id") == F.col("keep_id"), F.lit(False))
    return out.select(F.col("id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"), kept.alias("kept"), "digest", "text_sha256")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), keep="max").drop("digest")


OP10_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
