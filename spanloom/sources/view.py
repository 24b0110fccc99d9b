"""Interval tables derived from the order tables: an order is a transcript, a line number an exon, customers share chromosomes.

The projection is integer-only, so that any SQL engine gives the same rows. Line numbers repeat within an order and are made unique first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, tid, gene, s, e, strand, lib, sample, score, ref, tst: one row per exon, 0-based half-open."""
    # Lines are dealt by order once: grouping, join and the transcripts' exons then find them in one place.
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("pk"), F.max("l_quantity").alias("q"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")
    both = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return both.selectExpr(
        "concat('chr', 1 + o_custkey % 22) AS chrom",
        "o_orderkey AS tid",
        "concat('G', o_custkey) AS gene",
        "(o_custkey div 22) * 20000 + (l_linenumber - 1) * 2000 + (pk % 2) * 200 AS s",
        "(o_custkey div 22) * 20000 + (l_linenumber - 1) * 2000 + (pk % 2) * 200 + 300 + (CAST(floor(q) AS BIGINT) % 2) * 100 AS e",
        "CASE WHEN o_orderkey % 11 = 0 THEN '.' WHEN (o_custkey + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END) % 2 = 0 THEN '+' ELSE '-' END AS strand",
        "concat('L', o_orderkey % 8) AS lib",
        "concat('S', (o_orderkey % 8) div 2) AS sample",
        "CAST(floor(o_totalprice) AS BIGINT) AS score",
        "(o_orderkey % 5 = 0 AND o_orderkey % 11 <> 0) AS ref",
        "(o_orderkey % 25 = 0 AND o_orderkey % 11 <> 0) AS tst",
    )


def transcripts(exon_rows: DataFrame) -> DataFrame:
    """One row per transcript: its attributes, span, exons (sorted), n_exons and length (exonic bases)."""
    attrs = [c for c in exon_rows.columns if c not in ("tid", "s", "e")]
    grouped = exon_rows.groupBy("tid").agg(*(F.min(c).alias(c) for c in attrs), F.min("s").alias("s"), F.max("e").alias("e"), F.sort_array(F.collect_list(F.struct("s", "e"))).alias("exons"))
    return grouped.withColumn("n_exons", F.size("exons")).withColumn("length", F.aggregate("exons", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"]))


#: The same views as common table expressions for an SQL engine with // and %.
VIEW_SQL = """
WITH l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS pk, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
ex AS (SELECT 'chr' || (1 + o_custkey % 22) AS chrom, o_orderkey AS tid, 'G' || o_custkey AS gene,
    (o_custkey // 22) * 20000 + (l_linenumber - 1) * 2000 + (pk % 2) * 200 AS s,
    (o_custkey // 22) * 20000 + (l_linenumber - 1) * 2000 + (pk % 2) * 200 + 300 + (CAST(floor(q) AS BIGINT) % 2) * 100 AS e,
    CASE WHEN o_orderkey % 11 = 0 THEN '.' WHEN (o_custkey + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END) % 2 = 0 THEN '+' ELSE '-' END AS strand,
    'L' || (o_orderkey % 8) AS lib, 'S' || ((o_orderkey % 8) // 2) AS sample, CAST(floor(o_totalprice) AS BIGINT) AS score,
    (o_orderkey % 5 = 0 AND o_orderkey % 11 <> 0) AS ref, (o_orderkey % 25 = 0 AND o_orderkey % 11 <> 0) AS tst
  FROM l JOIN orders ON l_orderkey = o_orderkey),
tx AS (SELECT tid, min(chrom) AS chrom, min(gene) AS gene, min(strand) AS strand, min(lib) AS lib, min(sample) AS sample, min(score) AS score,
    bool_or(ref) AS ref, bool_or(tst) AS tst, min(s) AS s, max(e) AS e, count(*) AS n_exons, CAST(sum(e - s) AS BIGINT) AS length
  FROM ex GROUP BY tid),
lo AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY chrom ORDER BY s, e, tid) AS BIGINT) AS locus FROM (
    SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY chrom ORDER BY s, e, tid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
      THEN 0 ELSE 1 END AS fresh FROM tx) AS t),
lex AS (SELECT ex.*, lo.locus FROM ex JOIN lo USING (tid))
"""
