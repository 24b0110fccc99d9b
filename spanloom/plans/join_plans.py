"""Queries of the joins (J) and of nearest-neighbour selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators import compare, joins
from spanloom.operators.intervals import introns
from spanloom.plans.book import View, query

INTRONS = "ig AS (SELECT chrom, tid, strand, ref, lib, e AS s, lead(s) OVER (PARTITION BY tid ORDER BY s) AS e FROM ex), it AS (SELECT * FROM ig WHERE e IS NOT NULL)"


def _sides(v: View) -> tuple[DataFrame, DataFrame]:
    return v.ex.where("NOT ref"), v.ex.where("ref")


def _introns(v: View) -> DataFrame:
    return introns(v.ex, ["chrom", "tid", "strand", "ref", "lib"])


@query("j1_overlap", "SELECT a.tid, a.s, a.e, b.tid AS b_tid, b.s AS b_s, b.e AS b_e FROM ex AS a JOIN ex AS b ON a.chrom = b.chrom AND a.s < b.e AND b.s < a.e WHERE NOT a.ref AND b.ref")
def overlap(v: View) -> DataFrame:
    a, b = _sides(v)
    return joins.overlap_join(a.select("chrom", "tid", "s", "e"), b.select("chrom", "tid", "s", "e"), ["chrom"]).drop("chrom")


NEAR = """
a AS (SELECT * FROM tx WHERE NOT ref), b AS (SELECT * FROM tx WHERE ref),
m AS (SELECT a.tid, b.tid AS ref_id, a.s - b.e AS dl, b.s - a.e AS dr FROM a JOIN b ON a.chrom = b.chrom AND (a.s - b.e BETWEEN 1 AND {d} OR b.s - a.e BETWEEN 1 AND {d})),
n AS (SELECT tid, ref_id, CASE WHEN dl >= 1 THEN 'left' ELSE 'right' END AS side, greatest(dl, dr) AS dist FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY tid, side ORDER BY dist, ref_id) AS rank FROM n)"""


@query("j2_nearest", NEAR.format(d=100000) + " SELECT tid, side, ref_id, dist FROM r WHERE rank = 1")
def nearest(v: View) -> DataFrame:
    a = v.tx.where("NOT ref").select("chrom", "tid", "s", "e")
    b = v.tx.where("ref").select("chrom", F.col("tid").alias("ref_id"), "s", "e")
    both = [joins.nearest(a, b, "chrom", side, 100_000, "tid", "ref_id").select("tid", F.lit(side).alias("side"), "ref_id", "dist") for side in ("left", "right")]
    return both[0].unionByName(both[1])


@query("j2_nearest_three", NEAR.format(d=30000) + " SELECT tid, side, ref_id AS near_ref_id, dist, rank FROM r WHERE rank <= 3")
def nearest_three(v: View) -> DataFrame:
    a = v.tx.where("NOT ref").select("chrom", "tid", "s", "e")
    return joins.nearest_within(a, v.tx.where("ref").select("chrom", F.col("tid").alias("ref_id"), "s", "e"), ["chrom"], 3, 30_000, "tid", "ref_id")


@query("j3_upstream", NEAR.format(d=30000) + """ SELECT tid, side, ref_id AS near_ref_id, dist, rank FROM r JOIN (SELECT tid, strand FROM tx) AS t USING (tid)
WHERE rank <= 2 AND side = CASE WHEN strand = '-' THEN 'right' ELSE 'left' END""")
def upstream(v: View) -> DataFrame:
    a = v.tx.where("NOT ref").select("chrom", "tid", "strand", "s", "e")
    return joins.stream_neighbours(a, v.tx.where("ref").select("chrom", F.col("tid").alias("ref_id"), "s", "e"), ["chrom"], "upstream", 2, 30_000, "tid", "ref_id")


NAMES = "h AS (SELECT a.tid, a.s, a.e, b.gene AS name FROM ex AS a LEFT JOIN (SELECT * FROM ex WHERE ref) AS b ON a.chrom = b.chrom AND a.strand = b.strand AND a.s < b.e AND b.s < a.e)"


@query("j4_exon_names", NAMES + " SELECT tid, s, e, coalesce(string_agg(DISTINCT name, ',' ORDER BY name), '') AS names FROM h GROUP BY tid, s, e")
def exon_names(v: View) -> DataFrame:
    return joins.annotate_names(v.ex, v.ex.where("ref").withColumn("name", F.col("gene")))[0]


@query("j4_transcript_names", NAMES + " SELECT tid, coalesce(string_agg(DISTINCT name, ',' ORDER BY name), '') AS names FROM h GROUP BY tid")
def transcript_names(v: View) -> DataFrame:
    return joins.annotate_names(v.ex, v.ex.where("ref").withColumn("name", F.col("gene")))[1]


META = "WITH m AS (SELECT l_orderkey, arg_max(l_partkey, (l_shipdate, l_partkey)) AS part FROM lineitem WHERE l_quantity > 25 GROUP BY 1)"


@query("j5_metadata_join", META + " SELECT o_orderkey AS tid, coalesce(CAST(part AS VARCHAR), 'NA') AS part, part IS NOT NULL AS matched FROM orders LEFT JOIN m ON o_orderkey = l_orderkey")
def metadata_join(v: View) -> DataFrame:
    meta = v.table("lineitem").where("l_quantity > 25").select("l_orderkey", F.col("l_partkey").alias("part"), F.struct("l_shipdate", "l_partkey").alias("pos"))
    return joins.left_join_table(v.table("orders").select(F.col("o_orderkey").alias("tid")), meta, "tid", "l_orderkey", "pos")


@query("j6_table_join_misses", META + " SELECT part IS NOT NULL AS matched, count(*) AS n FROM orders LEFT JOIN m ON o_orderkey = l_orderkey GROUP BY 1")
def table_join_misses(v: View) -> DataFrame:
    return metadata_join(v).groupBy("matched").agg(F.count(F.lit(1)).alias("n"))


@query("j7_first_match", """WITH b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey) AS n FROM lineitem WHERE l_discount > 0.05)
SELECT o_orderkey, l_partkey, l_suppkey FROM orders LEFT JOIN b ON o_orderkey = l_orderkey AND n = 1""")
def first_match(v: View) -> DataFrame:
    b = v.table("lineitem").where("l_discount > 0.05").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_suppkey", "l_shipdate")
    return joins.first_match_join(v.table("orders").select("o_orderkey"), b, "o_orderkey", ["l_shipdate", "l_partkey", "l_suppkey"]).drop("l_shipdate")


@query("j8_shared_introns", INTRONS + " SELECT a.tid AS a_tid, b.tid AS b_tid, count(*) AS n FROM it AS a JOIN it AS b USING (chrom, strand, s, e) WHERE NOT a.ref AND b.ref GROUP BY 1, 2")
def shared_introns(v: View) -> DataFrame:
    rows = _introns(v)
    return joins.shared_introns(rows.where("NOT ref"), rows.where("ref"))


@query("j9_shared_nodes", """
b AS (SELECT DISTINCT chrom, locus, unnest([s, e]) AS pos FROM lex),
c AS (SELECT chrom, locus, pos AS seg_s, lead(pos) OVER (PARTITION BY chrom, locus ORDER BY pos) AS seg_e FROM b),
seg AS (SELECT lex.*, seg_s, seg_e FROM lex JOIN c USING (chrom, locus) WHERE seg_s >= s AND seg_e <= e)
SELECT a.tid, r.tid AS ref_id, a.strand = r.strand AS same, CAST(sum(a.seg_e - a.seg_s) AS BIGINT) AS bases
FROM seg AS a JOIN seg AS r USING (chrom, locus, seg_s, seg_e) WHERE NOT a.ref AND r.ref GROUP BY ALL""")
def shared_nodes(v: View) -> DataFrame:
    from spanloom.operators.annotate import nodes

    seg = nodes(v.loci[1].select("chrom", "locus", "tid", "strand", "ref", "s", "e"))
    a = seg.where("NOT ref").drop("ref")
    r = seg.where("ref").select("chrom", "locus", "s", "e", F.col("tid").alias("ref_id"), F.col("strand").alias("r_strand"))
    return a.join(r, ["chrom", "locus", "s", "e"]).groupBy("tid", "ref_id", (F.col("strand") == F.col("r_strand")).alias("same")).agg(F.sum(F.col("e") - F.col("s")).alias("bases"))


PATTERNS = INTRONS + ", pt AS (SELECT tid, chrom, strand, ref, string_agg(s || '-' || e, ',' ORDER BY s) AS pattern FROM it GROUP BY ALL)"


@query("j10_splicing_patterns", PATTERNS + " SELECT a.tid, b.tid AS ref_id, pattern FROM pt AS a JOIN pt AS b USING (chrom, strand, pattern) WHERE NOT a.ref AND b.ref")
def splicing_patterns(v: View) -> DataFrame:
    rows = _introns(v)
    a, b = joins.splicing_patterns(rows.where("NOT ref")), joins.splicing_patterns(rows.where("ref")).withColumnRenamed("tid", "ref_id")
    return a.join(b, ["chrom", "strand", "pattern"]).select("tid", "ref_id", "pattern")


@query("j11_known_junctions", INTRONS + """,
f AS (SELECT DISTINCT lib, chrom, s, e FROM it WHERE NOT ref), k AS (SELECT DISTINCT chrom, s, e FROM it WHERE ref AND chrom <> 'chr3'), c AS (SELECT DISTINCT chrom FROM k),
x AS (SELECT f.*, k.s IS NOT NULL AS known, c.chrom IS NOT NULL AS has FROM f LEFT JOIN k ON f.chrom = k.chrom AND f.s = k.s AND f.e = k.e LEFT JOIN c ON f.chrom = c.chrom)
SELECT lib, count(*) FILTER (known) AS known, count(*) FILTER (NOT known AND has) AS novel, count(*) FILTER (NOT has) AS no_chrom FROM x GROUP BY lib""")
def known_junctions(v: View) -> DataFrame:
    rows = _introns(v)
    return joins.known_junctions(rows.where("NOT ref"), rows.where("ref AND chrom <> 'chr3'"))


@query("j12_locus_gene_exons", """
SELECT a.tid, b.gene AS ref_gene, count(*) AS n_overlaps FROM lex AS a JOIN lex AS b ON a.chrom = b.chrom AND a.s < b.e AND b.s < a.e WHERE NOT a.ref AND b.ref GROUP BY 1, 2""")
def locus_gene_exons(v: View) -> DataFrame:
    """The locus level is implied by overlap, so exons are joined directly."""
    a, b = _sides(v)
    hits = joins.overlap_join(a.select("chrom", "tid", "s", "e"), b.select("chrom", "gene", "s", "e"), ["chrom"])
    return hits.groupBy("tid", F.col("b_gene").alias("ref_gene")).agg(F.count(F.lit(1)).alias("n_overlaps"))


@query("j13_results_join", "SELECT tid, coalesce(CAST(any_value(o_totalprice) FILTER (o_orderstatus = 'O') AS VARCHAR), 'SKIPPED') = 'SKIPPED' AS skipped FROM tx JOIN orders ON tid = o_orderkey GROUP BY tid")
def results_join(v: View) -> DataFrame:
    results = v.table("orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").cast("string").alias("result"), F.lit(0).alias("pos"))
    joined = joins.left_join_table(v.tx.select("tid"), results, "tid", "key", "pos", missing="SKIPPED")
    return joined.select("tid", (F.col("result") == "SKIPPED").alias("skipped"))


@query("j14_containment", INTRONS + ", d AS (SELECT DISTINCT chrom, strand, s, e FROM it) SELECT tx.tid, d.strand AS b_strand, d.s AS b_s, d.e AS b_e FROM tx JOIN d ON tx.chrom = d.chrom AND d.s < tx.s AND d.e > tx.e")
def containment(v: View) -> DataFrame:
    gaps = _introns(v).select("chrom", "strand", "s", "e").distinct()
    hits = joins.overlap_join(v.tx.select("chrom", "tid", "s", "e"), gaps, ["chrom"])
    return hits.where(joins.contains_strictly(F.col("b_s"), F.col("b_e"), F.col("s"), F.col("e"))).select("tid", "b_strand", "b_s", "b_e")


REF_LOCI = """
rf AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY chrom ORDER BY s, e, tid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS brk FROM tx WHERE ref),
rm AS MATERIALIZED (SELECT *, chrom || ':' || CAST(sum(brk) OVER (PARTITION BY chrom ORDER BY s, e, tid) AS BIGINT) AS ref_locus FROM rf),
rl AS MATERIALIZED (SELECT chrom, ref_locus, min(s) AS s, max(e) AS e FROM rm GROUP BY chrom, ref_locus),
rn AS (SELECT a.tid, ref_locus, CASE WHEN a.s - b.e >= 1 THEN 'left' ELSE 'right' END AS side, greatest(a.s - b.e, b.s - a.e) AS dist FROM {asks} AS a JOIN rl AS b ON a.chrom = b.chrom AND (a.s - b.e >= 1 OR b.s - a.e >= 1)),
rk AS (SELECT *, row_number() OVER (PARTITION BY tid, side ORDER BY dist, ref_locus) AS k FROM rn),
ra AS (SELECT tid, side, ref_locus FROM rk WHERE k = 1 UNION ALL SELECT a.tid, 'within', ref_locus FROM {asks} AS a JOIN rl AS b ON a.chrom = b.chrom AND a.s < b.e AND b.s < a.e),
im AS MATERIALIZED (SELECT a.tid, side, m.tid AS ref_id, CASE WHEN side <> 'within' THEN 'intergenic' WHEN a.strand = m.strand OR a.strand = '.' OR m.strand = '.' THEN 'encompassing_same_strand' ELSE 'encompassing_opp_strand' END AS category,
    CASE WHEN side = 'within' THEN 0 ELSE least(abs(a.s - m.e), abs(m.s - a.e)) END AS distance FROM ra JOIN {asks} AS a ON ra.tid = a.tid JOIN rm AS m ON ra.ref_locus = m.ref_locus)"""


@query("r6_nearest_loci", "aq AS (SELECT * FROM tx WHERE NOT ref)," + REF_LOCI.format(asks="aq") + " SELECT tid, side, ref_id, category, distance FROM im")
def nearest_loci(v: View) -> DataFrame:
    return compare.intergenic_matches(v.tx.where("NOT ref"), v.tx)


@query("r7_nearest_genes", """
b AS (SELECT chrom, gene, min(s) AS s, max(e) AS e FROM tx WHERE ref GROUP BY chrom, gene), a AS (SELECT * FROM tx WHERE NOT ref),
m AS (SELECT a.tid, b.gene, a.s - b.e AS dl, b.s - a.e AS dr FROM a JOIN b ON a.chrom = b.chrom),
lf AS (SELECT tid, gene, dl, row_number() OVER (PARTITION BY tid ORDER BY dl, gene) AS n FROM m WHERE dl BETWEEN 1 AND 1000000),
rt AS (SELECT tid, gene, dr, row_number() OVER (PARTITION BY tid ORDER BY dr, gene) AS n FROM m WHERE dr BETWEEN 1 AND 1000000)
SELECT a.tid, coalesce(lf.gene, 'NA') AS left_gene, coalesce(dl, -1) AS left_dist, coalesce(rt.gene, 'NA') AS right_gene, coalesce(dr, -1) AS right_dist
FROM a LEFT JOIN lf ON a.tid = lf.tid AND lf.n = 1 LEFT JOIN rt ON a.tid = rt.tid AND rt.n = 1""")
def nearest_genes(v: View) -> DataFrame:
    return compare.nearest_genes(v.tx)
