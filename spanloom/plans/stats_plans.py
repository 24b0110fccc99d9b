"""Queries of aggregates, ranks and selections (A, R) and of sequence functions (S)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import sequence as sq
from spanloom.operators import filters as fl
from spanloom.operators import stats as st
from spanloom.operators.intervals import introns
from spanloom.plans.book import SIZES_SQL, View, query
from spanloom.plans.filter_plans import CLIP
from spanloom.plans.interval_plans import MERGED, SEGMENTS
from spanloom.plans.join_plans import INTRONS


@query("a1_node_scores", SEGMENTS + " SELECT chrom, locus, strand, seg_s AS s, seg_e AS e, CAST(sum(score) AS BIGINT) AS score FROM seg GROUP BY ALL")
def node_scores(v: View) -> DataFrame:
    from spanloom.operators.annotate import node_scores as scores
    from spanloom.operators.annotate import nodes

    return scores(nodes(v.loci[1])).select("chrom", "locus", "strand", "s", "e", "score")


@query("a3_percentile_rank", "SELECT tid, lib, round(100.0 * (rank() OVER (PARTITION BY lib ORDER BY score) - 1) / count(*) OVER (PARTITION BY lib), 6)::DOUBLE AS pct FROM tx")
def percentile_rank(v: View) -> DataFrame:
    return st.left_ecdf_rank(v.tx.select("tid", "lib", "score"), "lib", "score").select("tid", "lib", F.round("pct", 6).alias("pct"))


@query("a4_quantiles", "SELECT lib, " + ", ".join(f"round(quantile_cont(CAST(score AS DOUBLE), {p / 100}), 4) AS q{p}" for p in st.PERCENTS) + " FROM tx GROUP BY lib")
def quantiles(v: View) -> DataFrame:
    q = st.quantiles(v.tx, ["lib"], "score")
    return q.select("lib", *(F.round(f"q{p}", 4).alias(f"q{p}") for p in st.PERCENTS))


@query("a4_discrete_quantiles", """
r AS (SELECT lib, score, row_number() OVER (PARTITION BY lib ORDER BY score) - 1 AS n, (count(*) OVER (PARTITION BY lib) - 1) * 0.37 AS pos FROM tx)
SELECT lib, min(score) FILTER (n = floor(pos)) AS lower, min(score) FILTER (n = ceil(pos)) AS higher FROM r GROUP BY lib""")
def discrete_quantiles(v: View) -> DataFrame:
    return st.discrete_quantile(v.tx, ["lib"], "score", 37, "lower").join(st.discrete_quantile(v.tx, ["lib"], "score", 37, "higher"), "lib")


@query("a5_ecdf_band", """
c AS (SELECT lib, n_exons, count(*) AS n FROM tx GROUP BY ALL),
y AS (SELECT lib, n_exons, sum(n) OVER (PARTITION BY lib ORDER BY n_exons) / sum(n) OVER (PARTITION BY lib) AS y, sqrt(ln(2 / 0.05) / (2 * sum(n) OVER (PARTITION BY lib))) AS eps FROM c)
SELECT lib, n_exons, round(y, 6) AS ecdf, round(greatest(y - eps, 0), 6) AS low, round(least(y + eps, 1), 6) AS high FROM y""")
def ecdf_band(v: View) -> DataFrame:
    band = st.ecdf_band(v.tx.withColumn("n_exons", F.col("n_exons").cast("long")), "lib", "n_exons")
    return band.select("lib", "n_exons", *(F.round(c, 6).alias(c) for c in ("ecdf", "low", "high")))


@query("a6_step_lookup", """
p AS (SELECT p_partkey * 7 AS x, max(p_retailprice) AS y FROM part GROUP BY 1)
SELECT o_orderkey, coalesce((SELECT arg_max(y, p.x) FROM p WHERE p.x <= o_orderkey), 0.0) AS y FROM orders""")
def step_lookup(v: View) -> DataFrame:
    steps = v.table("part").groupBy((F.col("p_partkey") * 7).alias("x")).agg(F.max("p_retailprice").alias("y"))
    return st.step_lookup(v.table("orders").select("o_orderkey", F.col("o_orderkey").alias("x")), steps, "x", "y").select("o_orderkey", "y")


@query("a7_library_stats", CLIP.format(x=350) + ", j AS (SELECT cl.*, lib, score::DOUBLE AS score, cl.length <= 700 AS bad FROM cl JOIN (SELECT tid, lib, score FROM tx) AS t USING (tid)) SELECT lib, count(*) FILTER (NOT bad) AS passed, count(*) FILTER (bad) AS failed, count(*) FILTER (bad) AS too_short, count(*) FILTER (clipped) AS too_short_exon, " + ", ".join(f"round(quantile_cont(score, {p / 100}) FILTER ({w}), 4) AS {k}_q{p}" for k, w in (("failed", "bad"), ("passed", "NOT bad")) for p in st.PERCENTS) + " FROM j GROUP BY lib")
def library_stats(v: View) -> DataFrame:
    out = st.library_stats(fl.aggregate_filter(v.tx, min_length=700, min_exon=350))
    return out.select(*(F.round(c, 4).alias(c) if "_q" in c else F.col(c) for c in out.columns))


@query("a8_category_stats", "SELECT lib, " + ", ".join(f"count(*) FILTER (c = {k}) AS c{k}_count, coalesce(CAST(sum(score) FILTER (c = {k}) AS BIGINT), 0) AS c{k}_signal" for k in range(7)) + " FROM (SELECT *, CASE WHEN tst THEN 0 ELSE tid % 7 END AS c FROM tx) GROUP BY lib")
def category_stats(v: View) -> DataFrame:
    return st.category_stats(v.tx.withColumn("category", F.col("tid") % 7), [f"c{k}" for k in range(7)])


@query("a9_distinct_by_attribute", "SELECT lib, count(DISTINCT gene) AS n FROM ex GROUP BY lib")
def distinct_by_attribute(v: View) -> DataFrame:
    return st.distinct_by(v.ex, "lib", "gene")


@query("a10_feature_stats", INTRONS + """ SELECT 'genes' AS what, count(DISTINCT gene) AS n FROM ex UNION ALL SELECT 'transcripts', count(DISTINCT tid) FROM ex
UNION ALL SELECT 'exons', count(*) FROM (SELECT DISTINCT chrom, strand, s, e FROM ex) UNION ALL SELECT 'introns', count(*) FROM (SELECT DISTINCT chrom, strand, s, e FROM it)""")
def feature_stats(v: View) -> DataFrame:
    return st.feature_stats(v.ex, introns(v.ex, ["chrom", "strand", "tid"]))


@query("a11_gene_metadata", MERGED.format(by="gene, chrom", table="ex") + """,
m AS (SELECT gene, count(*) AS n_exons, CAST(sum(e - s) AS BIGINT) AS bases FROM mm GROUP BY gene), x AS (SELECT gene, string_agg(DISTINCT x, ',' ORDER BY x) AS libs FROM (SELECT gene, unnest([lib, sample]) AS x FROM ex) GROUP BY gene)
SELECT gene, n_exons, bases, libs FROM m JOIN x USING (gene)""")
def gene_metadata(v: View) -> DataFrame:
    from spanloom.operators.annotate import merged_gene_bases

    values = v.ex.select("gene", F.concat_ws(",", "lib", "sample").alias("csv")).groupBy("gene").agg(st.csv_values("csv").alias("libs"))
    return merged_gene_bases(v.ex).join(values, "gene")


LIBS = [f"L{k}" for k in range(8)]


@query("a12_expression_matrix", "SELECT gene, " + ", ".join(f"max(score) FILTER (lib = '{x}') AS {x}" for x in LIBS) + " FROM tx GROUP BY gene")
def expression_matrix(v: View) -> DataFrame:
    long = v.tx.groupBy("gene", "lib").agg(F.max("score").alias("score"))
    return st.expression_matrix(long, LIBS, row="gene")


@query("a13_counts_from_fpkm", "SELECT tid, round_even(CAST(score AS DOUBLE) / 7 * (length / 1e3) * (1e6 / 1e6), 2) AS reads FROM tx")
def counts_from_fpkm(v: View) -> DataFrame:
    return v.tx.select("tid", st.fpkm_to_counts(F.col("score") / 7, F.col("length"), F.lit(1e6)).alias("reads"))


@query("a14_row_summary", "SELECT gene, round(avg(score), 4) AS mean, " + ", ".join(f"round(quantile_cont(CAST(score AS DOUBLE), {p / 100}), 4) AS p{p}" for p in st.PERCENTS) + " FROM tx GROUP BY gene")
def row_summary(v: View) -> DataFrame:
    return st.row_summary(v.tx, "gene", "score")


@query("a15_matrix_subset", "SELECT tid, lib, score FROM tx WHERE ref AND lib IN ('L1', 'L6')")
def matrix_subset(v: View) -> DataFrame:
    libs = v.tx.select("lib").where("lib IN ('L1', 'L6')")
    return st.matrix_subset(v.tx.select("tid", "lib", "score"), v.tx.where("ref").select("tid"), libs)


TRACK = MERGED.format(by="chrom", table="(SELECT * FROM ex WHERE ref)") + ", tr AS (SELECT chrom, s AS b_s, e AS b_e, (s // 100 % 7)::DOUBLE AS v FROM mm)"


def _track(v: View) -> DataFrame:
    """A track without overlaps: merged reference exons, with a value from their place."""
    from spanloom.operators.intervals import clusters

    return clusters(v.ex.where("ref"), ["chrom"]).select("chrom", "s", "e", F.expr("cast(s div 100 % 7 as double)").alias("value"))


@query("a16_track_means", TRACK + """, h AS (SELECT tid, v, least(e, b_e) - greatest(s, b_s) AS n FROM ex JOIN tr ON ex.chrom = tr.chrom AND s < b_e AND b_s < e)
SELECT tid, round(sum(v * n) / sum(n), 6) AS mean, round(coalesce(sum(n) FILTER (v >= 3), 0) / sum(n), 6) AS frac, CAST(sum(n) AS BIGINT) AS n_covered FROM h GROUP BY tid""")
def track_means(v: View) -> DataFrame:
    out = st.track_means(v.ex, _track(v), 3.0)
    return out.select("tid", F.round("mean", 6).alias("mean"), F.round("frac", 6).alias("frac"), "n_covered")


@query("a17_best_window", """
b AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
w AS (SELECT *, count(q) OVER x AS n, max(l_linenumber) OVER x - min(l_linenumber) OVER x AS d, avg(q) OVER x AS m FROM b WINDOW x AS (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT l_orderkey, round(max(CASE WHEN n = 3 AND d = 2 THEN m END), 6) AS best FROM w GROUP BY l_orderkey""")
def best_window(v: View) -> DataFrame:
    b = v.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    return st.best_window(b, "l_orderkey", "l_linenumber", "q", 3).select("l_orderkey", F.round("best", 6).alias("best"))


@query("a17_best_stretch_window", """
t AS (SELECT l_orderkey, l_linenumber * 10 AS s, l_linenumber * 10 + CASE WHEN min(l_partkey) % 3 = 0 THEN 7 ELSE 10 END AS e, max(l_quantity) AS v FROM lineitem GROUP BY l_orderkey, l_linenumber),
b AS (SELECT l_orderkey, unnest(range(s, e)) AS pos, v FROM t),
w AS (SELECT *, count(*) OVER x AS n, max(pos) OVER x - min(pos) OVER x AS d, avg(v) OVER x AS m FROM b WINDOW x AS (PARTITION BY l_orderkey ORDER BY pos ROWS BETWEEN 14 PRECEDING AND CURRENT ROW))
SELECT l_orderkey, round(max(CASE WHEN n = 15 AND d = 14 THEN m END), 6) AS best FROM w GROUP BY l_orderkey""")
def best_stretch_window(v: View) -> DataFrame:
    """Lines as stretches of ten positions, some with a gap behind them."""
    end = F.col("l_linenumber") * 10 + F.when(F.min("l_partkey") % 3 == 0, 7).otherwise(10)
    lines = v.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(end.cast("long").alias("e"), F.max("l_quantity").alias("value"))
    track = lines.select("l_orderkey", (F.col("l_linenumber") * 10).cast("long").alias("s"), "e", "value")
    return st.best_stretch_window(track, "l_orderkey", 15).select("l_orderkey", F.round("best", 6).alias("best"))


@query("a18_histogram", """
c AS (SELECT event_type, least(greatest(value, 0), 100) AS x FROM events), d AS (SELECT event_type, least(CAST(floor(x / 0.5) AS BIGINT), 199) AS bin, count(*) AS n FROM c GROUP BY ALL)
SELECT event_type, bin, n, round(sum(n) OVER (PARTITION BY event_type ORDER BY bin) / sum(n) OVER (PARTITION BY event_type), 6) AS cdf FROM d""")
def histogram(v: View) -> DataFrame:
    out = st.histogram_cdf(v.table("events"), "event_type", "value", 0.0, 100.0, 200)
    return out.withColumn("cdf", F.round("cdf", 6))


CONFUSION = """
p AS (SELECT (o_orderkey * 37 % 1000) / 1000.0 AS x, o_orderstatus = 'O' AS y FROM orders),
k AS (SELECT unnest(range(0, 1001)) / 1000.0 AS c),
t AS (SELECT c, count(*) FILTER (y AND x >= c) AS tp, count(*) FILTER (NOT y AND x >= c) AS fp, count(*) FILTER (y AND x < c) AS fn, count(*) FILTER (NOT y AND x < c) AS tn FROM k, p GROUP BY c),
r AS (SELECT *, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS sens, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0.0 END AS spec, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS prec FROM t)"""


def _confusion(v: View) -> DataFrame:
    return st.confusion(v.table("orders").select((F.col("o_orderkey") * 37 % 1000 / 1000).alias("x"), (F.col("o_orderstatus") == "O").alias("y")), "x", "y")


@query("a20_confusion", "WITH" + CONFUSION + " SELECT round(c, 3)::DOUBLE AS cutoff, tp, fp, fn, tn, round(sens, 6) AS sens, round(spec, 6) AS spec, round(prec, 6) AS prec, round(CASE WHEN prec + sens > 0 THEN 2 * prec * sens / (prec + sens) ELSE 0.0 END, 6) AS f, round((sens + spec) / 2, 6) AS balacc FROM r")
def confusion(v: View) -> DataFrame:
    m = _confusion(v)
    return m.select(F.round("cutoff", 3).alias("cutoff"), "tp", "fp", "fn", "tn", *(F.round(c, 6).alias(c) for c in ("sens", "spec", "prec", "f", "balacc")))


@query("a21_auc", """
p AS (SELECT o_orderpriority AS g, o_orderkey * 37 % 1000 AS x, o_orderstatus = 'O' AS y FROM orders),
r AS (SELECT g, y, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2 AS r FROM p),
s AS (SELECT g, sum(r) FILTER (y) AS r, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS q FROM r GROUP BY g)
SELECT g, round((r - p * (p + 1) / 2) / (p * q), 6) AS auc FROM s""")
def area(v: View) -> DataFrame:
    rows = v.table("orders").select(F.col("o_orderpriority").alias("g"), (F.col("o_orderkey") * 37 % 1000).alias("x"), (F.col("o_orderstatus") == "O").alias("y"))
    return st.auc(rows, "g", "x", "y").select("g", F.round("auc", 6).alias("auc"))


@query("r4_best_row", """WITH n AS (SELECT *, CASE WHEN event_type = 'click' THEN NULL ELSE value END AS x FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY x DESC NULLS LAST, event_id) AS k FROM n) SELECT user_id, event_id FROM r WHERE k = 1""")
def best_row(v: View) -> DataFrame:
    rows = v.table("events").select("user_id", "event_id", F.when(F.col("event_type") == "click", F.element_at(F.array(F.lit("NA"), F.lit("nan"), F.lit("None")), (F.col("event_id") % 3 + 1).cast("int"))).otherwise(F.col("value").cast("string")).alias("x"))
    return st.best_row(rows, "user_id", "x", ["event_id"]).select("user_id", "event_id")


@query("r8_best_cutoff", "WITH" + CONFUSION + ", b AS (SELECT c, round((sens + spec) / 2, 9) AS value, 'first' AS which FROM r ORDER BY value DESC, c LIMIT 1), d AS (SELECT c, round(prec, 9) AS value, 'last' AS which FROM r WHERE sens >= 0.2 ORDER BY value DESC, c DESC LIMIT 1) SELECT which, round(c, 3)::DOUBLE AS cutoff, round(value, 6) AS value FROM (FROM b UNION ALL FROM d)")
def best_cutoff(v: View) -> DataFrame:
    m = _confusion(v)
    m = m.select("cutoff", "sens", *(F.round(c, 9).alias(c) for c in ("balacc", "prec")))
    first, last = st.best_cutoff(m), st.best_cutoff(m, "prec", last=True, least={"sens": 0.2})
    both = first.withColumn("which", F.lit("first")).unionByName(last.withColumn("which", F.lit("last")))
    return both.select("which", F.round("cutoff", 3).alias("cutoff"), F.round("value", 6).alias("value"))


@query("r10_external_sort", "SELECT event_id, row_number() OVER (ORDER BY user_id, value, event_id) AS pos FROM events")
def external_sort(v: View) -> DataFrame:
    return fl.global_rank(v.table("events").select("event_id", "user_id", "value"), ["user_id", "value", "event_id"], "pos").select("event_id", F.col("pos").cast("long").alias("pos"))


# Sequences: names of parts, letters mapped to bases.
DNA = "translate(upper(regexp_replace(p_name || p_type || p_brand, '[^A-Za-z0-9]', '', 'g')), 'BDEFHIJKLMOPQRSUVWXYZ0123456789', 'ACGTACGTACGTACGTACGTAACGTACGTAC')"


def _dna(v: View) -> DataFrame:
    text = F.upper(F.regexp_replace(F.concat("p_name", "p_type", "p_brand"), "[^A-Za-z0-9]", ""))
    strand = F.element_at(F.array(F.lit("+"), F.lit("-"), F.lit(".")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return v.table("part").select("p_partkey", strand.alias("strand"), F.translate(text, "BDEFHIJKLMOPQRSUVWXYZ0123456789", "ACGTACGTACGTACGTACGTAACGTACGTAC").alias("seq"))


@query("s1_complements", f"WITH d AS (SELECT p_partkey, {DNA} AS seq FROM part) SELECT p_partkey, reverse(translate(seq, 'ACGTN', 'TGCAN')) AS rc, translate(seq, 'T', 'U') AS rna, reverse(translate(translate(seq, 'T', 'U'), 'ACGU', 'UGCA')) AS rna_rc FROM d")
def complements(v: View) -> DataFrame:
    rna = sq.to_rna(F.col("seq"))
    return _dna(v).select("p_partkey", sq.reverse_complement(F.col("seq")).alias("rc"), rna.alias("rna"), sq.reverse_complement(rna, rna=True).alias("rna_rc"))


@query("s2_spliced", f"""WITH d AS (SELECT 'c' || p_partkey AS chrom, p_partkey, {DNA} AS seq FROM part),
x AS (SELECT p_partkey, substr(seq, 3, 7) || substr(seq, 13, 6) AS t FROM d)
SELECT p_partkey AS tid, CASE WHEN p_partkey % 3 = 1 THEN reverse(translate(t, 'ACGTN', 'TGCAN')) ELSE t END AS seq FROM x WHERE length(t) > 0""")
def spliced(v: View) -> DataFrame:
    d = _dna(v).withColumn("chrom", F.concat(F.lit("c"), "p_partkey"))
    exons = F.array(F.struct(F.lit(2).alias("s"), F.lit(9).alias("e")), F.struct(F.lit(12).alias("s"), F.lit(18).alias("e")))
    return sq.spliced(d.select(F.col("p_partkey").alias("tid"), "chrom", "strand", exons.alias("exons")), d.select("chrom", F.col("seq").alias("bases")))


CODONS = ", ".join(f"'{k}': '{x}'" for k, x in sq.codon_table().items())
FRAMES = f"""WITH d AS (SELECT p_partkey, p_partkey % 3 AS k, {DNA} AS seq FROM part),
f AS (SELECT p_partkey, i AS frame, CASE WHEN i < 3 THEN seq ELSE reverse(translate(seq, 'ACGTN', 'TGCAN')) END AS seq FROM (SELECT *, unnest(CASE WHEN k = 2 THEN range(0, 6) ELSE range(0, 3) END) AS i FROM d)),
p AS (SELECT p_partkey, frame, regexp_replace(coalesce(array_to_string(list_transform(range(0, (length(seq) - frame % 3) // 3), lambda i: coalesce(MAP {{{CODONS}}}[substr(seq, (i * 3 + frame % 3 + 1)::BIGINT, 3)], '.')), ''), ''), '[.]+$', '') AS protein FROM f)"""


@query("s3_frames", FRAMES + " SELECT p_partkey, frame, protein FROM p")
def frames(v: View) -> DataFrame:
    return sq.frames(_dna(v)).select("p_partkey", F.col("frame").cast("long").alias("frame"), "protein")


@query("s4_open_frames", FRAMES + r" SELECT p_partkey, frame, unnest(regexp_extract_all(protein, 'M[^*]*\*?')) AS orf FROM p")
def open_frames(v: View) -> DataFrame:
    return sq.frames(_dna(v)).select("p_partkey", F.col("frame").cast("long").alias("frame"), F.explode(sq.open_frames(F.col("protein"))).alias("orf"))


@query("s5_unique_orfs", FRAMES + r""", o AS (SELECT p_partkey, frame, unnest(regexp_extract_all(protein, 'M[^*]*\*?')) AS orf FROM p)
SELECT printf('ORF%09d', row_number() OVER (ORDER BY orf) - 1) AS orf_id, orf, length(orf) AS orf_length, count(*) AS total_occurrences, count(DISTINCT p_partkey % 50) AS unique_genomic_occurrences FROM o GROUP BY orf""")
def unique_orfs(v: View) -> DataFrame:
    found = open_frames(v).select("orf", (F.col("p_partkey") % 50).cast("string").alias("chrom"), F.lit("+").alias("strand"), F.lit(0).alias("s"), F.lit(1).alias("e"))
    return sq.unique_orfs(found).withColumn("orf_length", F.col("orf_length").cast("long"))


@query("s6_wrapped", f"WITH d AS (SELECT p_partkey, {DNA} AS seq FROM part) SELECT p_partkey, rtrim(regexp_replace(seq, '(.{{1,10}})', '\\1' || chr(10), 'g'), chr(10)) AS lines FROM d")
def wrapped(v: View) -> DataFrame:
    return _dna(v).select("p_partkey", sq.wrap(F.col("seq"), 10).alias("lines"))


@query("s7_nan_to_zero", "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 0.0 ELSE value END AS value FROM events")
def nan_to_zero(v: View) -> DataFrame:
    return v.table("events").select("event_id", F.nanvl(F.when(F.col("event_id") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("value")), F.lit(0.0)).alias("value"))


@query("s9_frame_fasta", FRAMES + " SELECT '>' || p_partkey || '|frame=' || frame || chr(10) || protein AS value FROM p")
def frame_fasta(v: View) -> DataFrame:
    from spanloom.sources.formats import fasta_records

    rows = sq.frames(_dna(v)).withColumn("name", F.concat("p_partkey", F.lit("|frame="), "frame"))
    return fasta_records(rows, "name", "protein")


@query("r9_first_orf", f"""WITH d AS (SELECT p_partkey, p_partkey % 3 AS k, {DNA} AS seq FROM part),
r AS (SELECT p_partkey, k, unnest([{{'w': 0, 'q': seq}}, {{'w': 1, 'q': reverse(translate(seq, 'ACGTN', 'TGCAN'))}}]) AS u FROM d),
a AS (SELECT p_partkey, k, u.w AS w, u.q AS q, strpos(u.q, 'ATG') AS pos FROM r),
b AS (SELECT *, CASE WHEN pos > 0 THEN substr(q, pos) ELSE '' END AS t FROM a),
c AS (SELECT *, list_position(list_transform(range(0, length(t) // 3), lambda i: substr(t, (i * 3 + 1)::BIGINT, 3) IN ('TAA', 'TAG', 'TGA')), true) AS stop FROM b),
o AS (SELECT p_partkey, k, w, CASE WHEN stop > 0 THEN substr(t, 1, stop * 3) ELSE t END AS orf FROM c)
SELECT x.p_partkey, CASE WHEN x.k = 2 AND length(y.orf) > length(x.orf) THEN y.orf ELSE x.orf END AS orf FROM o AS x JOIN o AS y USING (p_partkey) WHERE x.w = 0 AND y.w = 1""")
def first_orf(v: View) -> DataFrame:
    return _dna(v).select("p_partkey", sq.longer_orf(F.col("seq"), F.col("strand")).alias("orf"))


@query("a0_chrom_sizes", SIZES_SQL + " SELECT chrom, size FROM sz")
def chrom_sizes(v: View) -> DataFrame:
    return v.sizes
