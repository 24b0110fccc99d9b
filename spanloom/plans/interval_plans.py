"""Queries of the interval algebra (IV)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators import intervals as iv
from spanloom.plans.book import SIZES_SQL, View, query, spans


@query("iv1_clusters", """
f AS (SELECT chrom, strand, s, e, tid, CASE WHEN s <= max(e) OVER w + 50 THEN 0 ELSE 1 END AS fresh FROM ex
  WINDOW w AS (PARTITION BY chrom, strand ORDER BY s, e, tid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY chrom, strand ORDER BY s, e, tid) AS k FROM f)
SELECT chrom, strand, min(s) AS s, max(e) AS e, count(*) AS n FROM g GROUP BY chrom, strand, k HAVING count(*) >= 2""")
def clusters(v: View) -> DataFrame:
    return iv.clusters(v.ex.select("chrom", "strand", "s", "e"), ["chrom", "strand"], max_dist=50, min_count=2).select("chrom", "strand", "s", "e", "n")


@query("iv2_loci", "SELECT tid, chrom, locus FROM lo")
def loci(v: View) -> DataFrame:
    return v.lo.select("tid", "chrom", "locus")


@query("iv3_boundaries", "SELECT DISTINCT chrom, locus, unnest([s, e]) AS pos FROM lex")
def boundaries(v: View) -> DataFrame:
    return iv.boundaries(v.lex, ["chrom", "locus"])


SEGMENTS = """
b AS (SELECT DISTINCT chrom, locus, unnest([s, e]) AS pos FROM lex),
c AS (SELECT chrom, locus, pos AS seg_s, lead(pos) OVER (PARTITION BY chrom, locus ORDER BY pos) AS seg_e FROM b),
seg AS MATERIALIZED (SELECT lex.*, seg_s, seg_e FROM lex JOIN c USING (chrom, locus) WHERE seg_s >= s AND seg_e <= e)"""


@query("iv4_segments", SEGMENTS + " SELECT tid, s, e, seg_s, seg_e FROM seg")
def segments(v: View) -> DataFrame:
    return iv.segments(v.loci[1], ["chrom", "locus"]).select("tid", "s", "e", "seg_s", "seg_e")


MERGED = """
mf AS (SELECT {by}, s, e, tid, CASE WHEN s <= max(e) OVER (PARTITION BY {by} ORDER BY s, e, tid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  THEN 0 ELSE 1 END AS fresh FROM {table}),
mg AS (SELECT *, sum(fresh) OVER (PARTITION BY {by} ORDER BY s, e, tid) AS k FROM mf),
mm AS (SELECT {by}, k, min(s) AS s, max(e) AS e FROM mg GROUP BY {by}, k)"""


@query("iv5_footprint", MERGED.format(by="chrom", table="ex") + " SELECT chrom, CAST(sum(e - s) AS BIGINT) AS bases FROM mm GROUP BY chrom")
def footprint(v: View) -> DataFrame:
    return iv.footprint(v.ex, ["chrom"])


@query("iv6_gene_sizes", MERGED.format(by="chrom, locus, gene", table="lex") + " SELECT chrom, locus, gene, CAST(sum(e - s) AS BIGINT) AS bases FROM mm GROUP BY ALL")
def gene_sizes(v: View) -> DataFrame:
    return iv.gene_sizes(v.lex)


@query("iv7_complement", SIZES_SQL + "," + MERGED.format(by="chrom", table="ex") + """,
g AS (SELECT chrom, coalesce(lag(e) OVER (PARTITION BY chrom ORDER BY s), 0) AS s, s AS e FROM mm
  UNION ALL SELECT chrom, max(e), any_value(size) FROM mm JOIN sz USING (chrom) GROUP BY chrom)
SELECT chrom, s, e FROM g WHERE e > s""")
def complement(v: View) -> DataFrame:
    return iv.complement(v.ex.select("chrom", "s", "e"), v.sizes)


@query("iv7_merged_introns", MERGED.format(by="chrom, locus", table="lex") + """,
g AS (SELECT chrom, locus, e AS s, lead(s) OVER (PARTITION BY chrom, locus ORDER BY s) AS e FROM mm) SELECT chrom, locus, s, e FROM g WHERE e IS NOT NULL""")
def merged_introns(v: View) -> DataFrame:
    return iv.introns(iv.clusters(v.lex, ["chrom", "locus"]), ["chrom", "locus"])


TSS = "CASE WHEN strand = '+' THEN s ELSE e - 1 END"


@query("iv8_promoters", SIZES_SQL + f""",
t AS (SELECT *, chrom || ':' || strand || ':' || ({TSS}) AS tss FROM tx WHERE strand <> '.'),
r AS (SELECT *, row_number() OVER (PARTITION BY tss ORDER BY s, e, tid) AS n FROM t)
SELECT chrom, tss, tid, strand, CASE WHEN strand = '+' THEN greatest(s - 500, 0) ELSE greatest(e - 200, s) END AS p_s,
  least(CASE WHEN strand = '+' THEN least(s + 200, e) ELSE e + 500 END, size) AS p_e
FROM r JOIN sz USING (chrom) WHERE n = 1""")
def promoters(v: View) -> DataFrame:
    return iv.promoters(iv.tss_ids(v.tx), 500, 200, v.sizes)


@query("iv9_promoter_clusters", f"""
t AS (SELECT DISTINCT chrom, chrom || ':' || strand || ':' || ({TSS}) AS tss, greatest(CASE WHEN strand = '+' THEN s - 300 ELSE e - 1 - 100 END, 0) AS s,
    CASE WHEN strand = '+' THEN s + 100 ELSE e - 1 + 300 END AS e FROM tx WHERE strand <> '.'),
f AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY chrom ORDER BY s, e, tss ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM t),
g AS (SELECT *, sum(fresh) OVER (ORDER BY chrom, s, e, tss) AS k FROM f)
SELECT tss, printf('P%07d', CAST(k AS BIGINT)) AS p_id, chrom AS p_chrom, min(s) OVER (PARTITION BY k) AS p_s, max(e) OVER (PARTITION BY k) AS p_e FROM g""")
def promoter_clusters(v: View) -> DataFrame:
    return iv.promoter_clusters(v.tx, 300, 100)


@query("iv10_gene_bounds", "SELECT chrom, locus, gene, min(s) AS s, max(e) AS e FROM lo GROUP BY ALL")
def gene_bounds(v: View) -> DataFrame:
    return iv.gene_bounds(v.lo)


@query("iv11_moved_genes", """
p AS (SELECT DISTINCT gene, 'chr' || (1 + CAST(substr(gene, 2) AS BIGINT) % 7) AS new_chrom, CAST(substr(gene, 2) AS BIGINT) * 11 AS new_s FROM tx),
d AS (SELECT gene, min(s) AS g_s FROM tx GROUP BY gene)
SELECT tid, gene, new_chrom AS chrom, strand, min(s) - any_value(g_s) + any_value(new_s) AS s, max(e) - any_value(g_s) + any_value(new_s) AS e,
  string_agg((s - g_s + new_s) || '-' || (e - g_s + new_s), ',' ORDER BY s) AS exons
FROM ex JOIN p USING (gene) JOIN d USING (gene) GROUP BY tid, gene, new_chrom, strand""")
def moved_genes(v: View) -> DataFrame:
    no = F.substring("gene", 2, 20).cast("long")
    places = v.tx.select("gene").distinct().select("gene", F.concat(F.lit("chr"), (1 + no % 7).cast("string")).alias("new_chrom"), (no * 11).alias("new_s"))
    return iv.moved(v.tx, places).withColumn("exons", spans())


#: pl: a place for each wanted length (wl: no, l) in the regions (reg: chrom, s, e), drawn with a seed.
PLACES = """
ls AS (SELECT DISTINCT l FROM wl),
cu AS (SELECT l, chrom, s, w - l + 1 AS n, sum(w - l + 1) OVER (PARTITION BY l ORDER BY w DESC, chrom, s, e) AS upto FROM ls JOIN (SELECT *, e - s AS w FROM reg) AS r ON w >= l),
tt AS (SELECT l, CAST(max(upto) AS BIGINT) AS t FROM cu GROUP BY l),
dr AS (SELECT no, l, CAST('0x' || substr(md5('{seed}:' || no), 1, 15) AS BIGINT) % t AS r FROM wl JOIN tt USING (l)),
pl AS (SELECT no, chrom, CAST(s + r - (upto - n) AS BIGINT) AS s, CAST(s + r - (upto - n) + dr.l AS BIGINT) AS e FROM dr ASOF JOIN (SELECT *, upto - n AS before FROM cu) AS c ON dr.l = c.l AND dr.r >= c.before
  UNION ALL SELECT no, NULL, NULL, NULL FROM wl WHERE l NOT IN (SELECT l FROM tt))"""


@query("iv11_shuffled_genes", SIZES_SQL + """,
wl AS (SELECT gene AS no, max(e) - min(s) AS l FROM tx GROUP BY gene), reg AS (SELECT chrom, 0 AS s, size AS e FROM sz),""" + PLACES.format(seed=7) + """,
d AS (SELECT gene, min(s) AS g_s FROM tx GROUP BY gene)
SELECT tid, gene, pl.chrom, strand, min(ex.s) - any_value(g_s) + any_value(pl.s) AS s, max(ex.e) - any_value(g_s) + any_value(pl.s) AS e,
  string_agg((ex.s - g_s + pl.s) || '-' || (ex.e - g_s + pl.s), ',' ORDER BY ex.s) AS exons
FROM ex JOIN pl ON pl.no = gene JOIN d USING (gene) GROUP BY tid, gene, pl.chrom, strand""")
def shuffled_genes(v: View) -> DataFrame:
    genes = v.tx.groupBy("gene").agg((F.max("e") - F.min("s")).alias("span"))
    return iv.moved(v.tx, iv.shuffled_places(genes, v.sizes, seed=7)).withColumn("exons", spans())


@query("iv12_random_intervals", MERGED.format(by="chrom", table="ex") + """,
wl AS (SELECT tid AS no, least(length, 250) AS l FROM tx), reg AS (SELECT chrom, s, e FROM mm),""" + PLACES.format(seed=3) + " SELECT no, chrom, s, e FROM pl")
def random_intervals(v: View) -> DataFrame:
    lengths = v.tx.select(F.col("tid").alias("no"), F.least(F.col("length"), F.lit(250)).alias("length"))
    return iv.random_intervals(iv.clusters(v.ex, ["chrom"]).select("chrom", "s", "e"), lengths, seed=3)


@query("iv13_mappable_windows", SIZES_SQL + "," + MERGED.format(by="chrom", table="ex") + """,
wl AS (SELECT tid AS no, 100 AS l FROM tx), reg AS (SELECT chrom, 0 AS s, size AS e FROM sz),""" + PLACES.format(seed=5) + """
SELECT no, pl.chrom, pl.s, pl.e, sum(least(pl.e, mm.e) - greatest(pl.s, mm.s)) / 100 AS mappable FROM pl JOIN mm ON pl.chrom = mm.chrom AND mm.s < pl.e AND mm.e > pl.s
GROUP BY no, pl.chrom, pl.s, pl.e HAVING sum(least(pl.e, mm.e) - greatest(pl.s, mm.s)) >= 50""")
def mappable_windows(v: View) -> DataFrame:
    """Random windows of 100 positions whose track mean (the share of covered positions) is at least a half."""
    from spanloom.operators.joins import overlap_join

    whole = v.sizes.select("chrom", F.lit(0).cast("long").alias("s"), F.col("size").cast("long").alias("e"))
    drawn = iv.random_intervals(whole, v.tx.select(F.col("tid").alias("no"), F.lit(100).cast("long").alias("length")), seed=5)
    track = iv.clusters(v.ex, ["chrom"]).select("chrom", "s", "e")
    hit = overlap_join(drawn, track, ["chrom"]).groupBy("no", "chrom", "s", "e").agg((F.sum(F.least("e", "b_e") - F.greatest("s", "b_s")) / 100).alias("mappable"))
    return hit.where("mappable >= 0.5")


@query("iv14_merged_genes", """
f AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY chrom, strand ORDER BY s, e, tid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM ex),
g AS (SELECT *, chrom || strand || sum(fresh) OVER (PARTITION BY chrom, strand ORDER BY s, e, tid) AS c FROM f),
n AS (SELECT DISTINCT c, tid FROM g),
o AS (SELECT tid, min(c) AS c0 FROM n GROUP BY tid),
p AS (SELECT DISTINCT c0 AS a, n.c AS b FROM n JOIN o USING (tid)),
q AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (WITH RECURSIVE w(c, root) AS (SELECT a, a FROM q UNION SELECT q.b, w.root FROM w JOIN q ON w.c = q.a) SELECT c, min(root) AS root FROM w GROUP BY c),
t AS (SELECT tid, min(root) AS root FROM n JOIN r USING (c) GROUP BY tid),
h AS (SELECT root, min({'chrom': chrom, 's': s, 'e': e, 'strand': strand}) AS place FROM ex JOIN t USING (tid) GROUP BY root),
i AS (SELECT root, printf('source%011d', row_number() OVER (ORDER BY place, root)) AS gene_id FROM h)
SELECT tid, gene_id, gene FROM t JOIN i USING (root) JOIN (SELECT tid, gene FROM tx) AS x USING (tid)""")
def merged_genes(v: View) -> DataFrame:
    from spanloom.operators.compare import merge_genes

    return merge_genes(v.ex)


@query("iv15_to_genome", """
x AS (SELECT *, sum(e - s) OVER (PARTITION BY tid ORDER BY CASE WHEN strand <> '-' THEN s ELSE -e END) AS t_e, sum(e - s) OVER (PARTITION BY tid) AS t_len FROM ex),
y AS (SELECT *, t_e - (e - s) AS t_s FROM x),
q AS (SELECT tid, unnest([0, 150, 400, 100000]) AS pos FROM tx)
SELECT tid, pos, CAST(CASE WHEN strand <> '-' THEN s + least(pos, t_len - 1) - t_s ELSE e - 1 - (least(pos, t_len - 1) - t_s) END AS BIGINT) AS g_pos
FROM q JOIN y USING (tid) WHERE least(pos, t_len - 1) >= t_s AND least(pos, t_len - 1) < t_e""")
def to_genome(v: View) -> DataFrame:
    points = v.tx.select("tid", F.explode(F.array(*map(F.lit, (0, 150, 400, 100000)))).alias("pos"))
    return iv.to_genome(v.ex, points)
