"""Queries of projections, filters, identifiers (F) and formats (IO)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators import filters as fl
from spanloom.plans.book import SPANS_SQL, View, query, spans
from spanloom.sources import formats as fm
from spanloom.sources.stages import stage


def _features(v: View) -> DataFrame:
    """Exon rows as parsed GTF features."""
    attrs = F.create_map(F.lit("gene_id"), F.col("gene"), F.lit("transcript_id"), F.col("tid").cast("string"), F.lit("lib"), F.col("lib"))
    return v.ex.select(F.col("chrom").alias("seqid"), F.lit("x").alias("source"), F.lit("exon").alias("feature_type"), "s", "e", F.col("score").cast("double").alias("score"), "strand", F.lit(".").alias("phase"), attrs.alias("attrs"))


GTF_SQL = """
g AS (SELECT tid, chrom, strand, gene, score, min(s) AS s, max(e) AS e, list({'s': s, 'e': e} ORDER BY s, e) AS x FROM ex GROUP BY ALL),
t AS (SELECT tid, 0 AS n, concat_ws(chr(9), chrom, 'spanloom', 'transcript', s + 1, e, score, strand, '.', 'gene_id "' || gene || '"; transcript_id "' || tid || '";') AS value FROM g
  UNION ALL SELECT tid, i, concat_ws(chr(9), chrom, 'spanloom', 'exon', x[i].s + 1, x[i].e, score, strand, '.', 'gene_id "' || gene || '"; transcript_id "' || tid || '"; exon_number "' || i || '";')
  FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM g))"""


@query("io1_parse_gtf", "SELECT chrom, tid, gene, s, e, score, strand, row_number() OVER (PARTITION BY tid ORDER BY s, e) AS exon_number FROM ex")
def parse_gtf(v: View) -> DataFrame:
    """Lines written, then parsed."""
    rows = fm.parse_gtf(fm.gtf_lines(v.tx), ["exon_number"]).where("feature_type = 'exon'")
    return rows.select(F.col("seqid").alias("chrom"), F.col("attrs")["transcript_id"].cast("long").alias("tid"), F.col("attrs")["gene_id"].alias("gene"), "s", "e", F.col("score").cast("long").alias("score"), "strand", F.col("exon_number").cast("long").alias("exon_number"))


@query("io2_write_gtf", GTF_SQL + " SELECT value FROM t")
def write_gtf(v: View) -> DataFrame:
    return fm.gtf_lines(v.tx)


@query("io3_sort_gtf", GTF_SQL + ", p AS (SELECT value, split_part(value, chr(9), 1) AS c, CAST(split_part(value, chr(9), 4) AS BIGINT) AS s, split_part(value, chr(9), 3) AS k FROM t) SELECT c AS seqid, s - 1 AS s, k AS feature_type, row_number() OVER (ORDER BY c, s, k DESC) AS pos FROM p")
def sort_gtf(v: View) -> DataFrame:
    rows = fm.parse_gtf(fm.gtf_lines(v.tx)).select("seqid", "s", "feature_type")
    down = rows.withColumn("kind", F.when(F.col("feature_type") == "transcript", 0).otherwise(1))  # transcript before exon
    return fl.global_rank(down, ["seqid", "s", "kind"], "pos").select("seqid", "s", "feature_type", F.col("pos").cast("long").alias("pos"))


@query("io4_locus_transcripts", f"SELECT chrom, locus, tid, {SPANS_SQL} AS exons FROM lex GROUP BY chrom, locus, tid")
def locus_transcripts(v: View) -> DataFrame:
    nested = fm.nest_transcripts(fm.parse_gtf(fm.gtf_lines(v.tx)))
    from spanloom.operators.intervals import with_loci

    return with_loci(nested).select("chrom", "locus", F.col("tid").cast("long").alias("tid"), spans().alias("exons"))


BED12 = """concat_ws(chr(9), chrom, min(s), max(e), {name}, score, strand, min(s), min(s), '0', count(*), string_agg(CAST(e - s AS VARCHAR), ',' ORDER BY s),
  string_agg(CAST(s - s0 AS VARCHAR), ',' ORDER BY s))"""
BED_FROM = " FROM (SELECT *, min(s) OVER (PARTITION BY tid) AS s0 FROM ex) GROUP BY tid, chrom, strand, gene, score"


@query("io5_parse_bed", "SELECT tid, chrom, CASE WHEN tid % 4 > 1 THEN CAST(tid AS VARCHAR) WHEN tid % 4 = 1 THEN CAST(tid AS VARCHAR) ELSE chrom || ':' || min(s) || '-' || max(e) END AS name, CASE WHEN tid % 4 >= 2 THEN strand ELSE '.' END AS strand, CASE WHEN tid % 4 = 3 THEN " + SPANS_SQL + " ELSE min(s) || '-' || max(e) END AS exons FROM ex GROUP BY tid, chrom, strand")
def parse_bed(v: View) -> DataFrame:
    """Lines of 3, 4, 6 and 12 columns."""
    f = F.split("value", "\t")
    n = F.element_at(F.array(F.lit(3), F.lit(4), F.lit(6), F.lit(12)), (F.col("tid") % 4 + 1).cast("int"))
    lines = v.tx.withColumn("value", fm.bed12_line(F.col("chrom"), F.col("s"), F.col("e"), F.col("tid").cast("string"), F.col("score"), F.col("strand"), F.col("exons")))
    cut = lines.select(F.array_join(F.slice(f, F.lit(1), n), "\t").alias("value"), "tid")
    # The parser sees the value only; the transcript is matched by its place in the text.
    parsed = fm.parse_bed(cut.withColumn("value", F.col("value")), default_name="place")
    ids = v.tx.select("tid", F.col("chrom").alias("c"), F.col("s").alias("a"), F.col("e").alias("b"), (F.col("tid") % 4).alias("k"))
    named = parsed.withColumn("key", F.when(F.col("name").contains(":"), None).otherwise(F.col("name").cast("long")))
    by_name = named.where("key IS NOT NULL").select(F.col("key").alias("tid"), "chrom", "name", "strand", spans().alias("exons"))
    places = ids.where("k = 0").withColumn("name", F.concat(F.col("c"), F.lit(":"), F.col("a"), F.lit("-"), F.col("b"))).select("tid", "name")
    by_place = named.where("key IS NULL").dropDuplicates(["name"]).join(places, "name").select("tid", "chrom", "name", "strand", spans().alias("exons"))
    return by_name.unionByName(by_place)


@query("io6_write_bed12", "SELECT " + BED12.format(name="tid") + " AS value" + BED_FROM)
def write_bed12(v: View) -> DataFrame:
    return fm.bed_lines(v.tx)


@query("io7_parse_genepred", """SELECT CASE WHEN n > 1 THEN gene || '.' || (n - 1) ELSE gene END AS name, chrom, strand, s, e, CASE WHEN ref THEN 'protein_coding' ELSE 'noncoding' END AS gene_type, n_exons
FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY chrom, s, e, strand) AS n FROM (SELECT DISTINCT ON (gene, chrom, s, e, strand) * FROM tx ORDER BY gene, chrom, s, e, strand, tid))""")
def parse_genepred(v: View) -> DataFrame:
    one = v.tx.groupBy("gene", "chrom", "s", "e", "strand").agg(F.min_by(F.struct("exons", "ref"), "tid").alias("r")).select("gene", "chrom", "s", "e", "strand", "r.*")
    line = fm.genepred_line([F.col("gene"), F.col("chrom"), F.col("strand"), F.col("s"), F.col("e"), F.col("s"), F.when(F.col("ref"), F.col("e")).otherwise(F.col("s"))], F.col("exons"))
    return fm.parse_genepred(one.select(line.alias("value"))).select("name", "chrom", "strand", "s", "e", "gene_type", F.size("exons").cast("long").alias("n_exons"))


@query("io8_bed_to_gtf", """SELECT chrom, CAST(tid AS VARCHAR) AS name, strand, 'transcript' AS feature_type, s, e, NULL::INT AS exon_number FROM tx
UNION ALL SELECT chrom, CAST(tid AS VARCHAR), strand, 'exon', s, e, CAST(row_number() OVER (PARTITION BY tid ORDER BY s, e) - 1 AS INT) FROM ex""")
def bed_to_gtf(v: View) -> DataFrame:
    return fm.bed_to_features(fm.parse_bed(fm.bed_lines(v.tx)))


@query("io9_gtf_to_bed", "SELECT " + BED12.format(name="gene || '|' || tid") + " AS value" + BED_FROM)
def gtf_to_bed(v: View) -> DataFrame:
    return fm.bed_lines(v.tx, with_gene=True)


NODES_SQL = """
b AS (SELECT DISTINCT chrom, locus, strand, unnest([s, e]) AS pos FROM lex),
c AS (SELECT chrom, locus, strand, pos AS a, lead(pos) OVER (PARTITION BY chrom, locus, strand ORDER BY pos) AS z FROM b),
nd AS (SELECT chrom, locus, strand, tid, score, a AS s, z AS e FROM lex JOIN c USING (chrom, locus, strand) WHERE a >= s AND z <= e)"""


@query("io10_bedgraph", NODES_SQL + " SELECT concat_ws(chr(9), chrom, s, e, CAST(sum(score) AS BIGINT)) AS value FROM nd WHERE strand = '+' GROUP BY chrom, locus, s, e")
def bedgraph(v: View) -> DataFrame:
    from spanloom.operators.assemble import splice_nodes

    return fm.bedgraph_lines(splice_nodes(v.loci[1]), "+")


@query("io11_sort_bed", "SELECT chrom, s, row_number() OVER (ORDER BY chrom, s, tid) AS pos FROM tx")
def sort_bed(v: View) -> DataFrame:
    return fl.global_rank(v.tx.select("chrom", "s", "tid"), ["chrom", "s", "tid"], "pos").select("chrom", "s", F.col("pos").cast("long").alias("pos"))


@query("io12_library_table", "SELECT DISTINCT lib AS library_id, sample AS sample_id, lib || '.gtf' AS gtf_file FROM ex")
def library_table(v: View) -> DataFrame:
    """Written and read as a headed, tab-separated table; columns come by name."""
    libs = v.ex.select(F.concat("lib", F.lit(".gtf")).alias("gtf_file"), F.col("sample").alias("sample_id"), F.col("lib").alias("library_id")).distinct()
    path = _path(v, "libraries")
    fm.write_table(libs, path)
    return fm.read_table(v.spark, path).select("library_id", "sample_id", "gtf_file")


@query("io12_library_features", """
f AS (SELECT lib, sample, tid, 'transcript' AS feature_type, s, e FROM tx UNION ALL SELECT lib, sample, tid, 'exon', s, e FROM ex)
SELECT lib AS library_id, sample AS sample_id, CAST(tid AS VARCHAR) AS transcript_id, feature_type, s, e, false AS corrupt FROM f
UNION ALL SELECT DISTINCT lib, NULL, 'no line of nine fields', NULL, NULL, NULL, true FROM tx""")
def library_features(v: View) -> DataFrame:
    """A set of files, one folder a library with a line in it that can't be read, found by the library table's paths."""
    path = _path(v, "gtf-set")
    lines = fm.gtf_lines(v.tx, keep=["lib"])
    broken = v.tx.select("lib").distinct().withColumn("value", F.lit("no line of nine fields"))
    lines.unionByName(broken).write.partitionBy("lib").text(path)
    table = v.tx.select(F.col("lib").alias("library_id"), F.col("sample").alias("sample_id"), F.concat(F.lit(f"{path}/lib="), "lib").alias("gtf_file")).distinct()
    features, bad = fm.read_libraries(v.spark, table)
    features = features.select("library_id", "sample_id", F.col("attrs")["transcript_id"].alias("transcript_id"), "feature_type", "s", "e", F.lit(False).alias("corrupt"))
    none = lambda t, c: F.lit(None).cast(t).alias(c)
    return features.unionByName(bad.select("library_id", none("string", "sample_id"), F.col("value").alias("transcript_id"), none("string", "feature_type"), none("long", "s"), none("long", "e"), F.lit(True).alias("corrupt")))


def _path(v: View, name: str) -> str:
    """A fresh folder beside the staged tables."""
    return stage(v.spark.range(1), name).inputFiles()[0].rsplit("/", 1)[0] + "-out"


@query("io13_split_by_library", "SELECT lib, tid FROM tx")
def split_by_library(v: View) -> DataFrame:
    path = _path(v, "split")
    fm.write_split(v.tx.select("lib", "tid"), path, "lib")
    return v.spark.read.parquet(path).select("lib", "tid")


@query("io14_stats_table", "SELECT lib, CAST(count(*) AS VARCHAR) AS n, CAST(CAST(sum(score) AS BIGINT) AS VARCHAR) AS signal FROM tx GROUP BY lib")
def stats_table(v: View) -> DataFrame:
    path = _path(v, "stats")
    fm.write_table(v.tx.groupBy("lib").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("signal")), path)
    return fm.read_table(v.spark, path)


@query("io15_metadata", "SELECT tid AS transcript_id, chrom, s, e, strand, n_exons AS num_exons, length AS transcript_length, gene FROM tx")
def metadata(v: View) -> DataFrame:
    return fm.metadata_table(v.ex)


@query("io16_split_fasta", "SELECT (row_number() OVER (ORDER BY p_partkey, p_name) - 1) % 3 AS part, CAST(p_partkey AS VARCHAR) AS name, p_name AS seq FROM part")
def split_fasta(v: View) -> DataFrame:
    """The records as they are read back from the files that they were dealt to."""
    path = _path(v, "fasta")
    rows = v.table("part").select("p_partkey", F.col("p_partkey").cast("string").alias("name"), F.col("p_name").alias("seq"))
    records = fm.fasta_records(rows, keep=["p_partkey", "seq"])
    fm.split_fasta(records, 3, path, ["p_partkey", "seq"])
    return fm.read_split_fasta(v.spark, path)


@query("io17_tracking", """SELECT CAST(o_orderkey AS VARCHAR) AS tid, o_custkey AS length, CASE WHEN o_orderstatus = 'O' THEN CAST(o_orderkey % 100 AS DOUBLE) / 4 END AS fpkm FROM orders""")
def tracking(v: View) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "OK").otherwise("FAIL")
    line = F.concat_ws("\t", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), (F.col("o_orderkey") % 100 / 4).cast("string"), status)
    return fm.parse_tracking(v.table("orders").select(line.alias("value")))


@query("io17_map_mass", "SELECT CAST(c_custkey AS DOUBLE) / 2 AS mass FROM customer WHERE c_acctbal > 0")
def map_mass(v: View) -> DataFrame:
    k = F.col("c_custkey")
    line = F.when(F.col("c_acctbal") > 0, F.concat(F.lit(">\tNormalized Map Mass: "), (k / 2).cast("string"))).otherwise("> Processing")
    return fm.map_mass(v.table("customer").select(line.alias("value")))


@query("io18_counts", "SELECT 'g' || p_partkey AS name, CAST(p_size AS BIGINT) AS n, false AS special FROM part UNION ALL SELECT 'no_feature', 7, true")
def counts(v: View) -> DataFrame:
    lines = v.table("part").select(F.concat(F.lit("g"), "p_partkey", F.lit("\t"), "p_size").alias("value"))
    return fm.parse_counts(lines.unionByName(v.spark.range(1).select(F.lit("no_feature\t7").alias("value"))))


JUNCTIONS = "j AS (SELECT tid, chrom, strand, e - 1 AS left_pos, lead(s) OVER (PARTITION BY tid ORDER BY s) AS right_pos FROM ex)"


@query("io19_bed_junctions", JUNCTIONS + ' SELECT chrom, left_pos AS "left", right_pos AS "right", strand FROM j WHERE right_pos IS NOT NULL')
def bed_junctions(v: View) -> DataFrame:
    return fm.bed_junctions(fm.parse_bed(fm.bed_lines(v.tx)))


@query("io19_raw_junctions", JUNCTIONS + ' SELECT chrom, left_pos AS "left", right_pos AS "right", strand FROM j WHERE right_pos IS NOT NULL')
def raw_junctions(v: View) -> DataFrame:
    found = bed_junctions(v)
    return fm.parse_junctions(found.select(F.concat_ws("\t", "chrom", F.col("left").cast("string"), F.col("right").cast("string"), "strand").alias("value")))


@query("io20_track_lines", """WITH l AS (SELECT DISTINCT 'L' || (o_orderkey % 8) AS lib FROM orders)
SELECT 'track type=bigWig name="' || lib || '" description="' || lib || '" visibility=full color=0,0,0 bigDataUrl=/tracks/' || lib || '.bw' AS value FROM l""")
def track_lines(v: View) -> DataFrame:
    """Signals are interval tables here; this is the text that points a browser at exported ones."""
    line = fm.track_line("@", "bigWig", "/tracks/@.bw")
    return v.table("orders").select(F.concat(F.lit("L"), F.col("o_orderkey") % 8).alias("lib")).distinct().select(F.replace(F.lit(line), F.lit("@"), "lib").alias("value"))


@query("io21_unpaired_flags", "WITH f AS (SELECT event_id, event_id % 4096 AS flag FROM events) SELECT event_id, flag & 65300 AS flag, -1 AS rnext FROM f")
def unpaired_flags(v: View) -> DataFrame:
    return fm.unpaired_flags(v.table("events").select("event_id", (F.col("event_id") % 4096).alias("flag")))


@query("io23_normalised", f"SELECT CAST(tid AS VARCHAR) AS tid, gene AS gene_id, gene AS gene_name, lib AS source, 'lincRNA' AS gene_type, chrom, strand, min(s) AS s, max(e) AS e, CASE WHEN strand = '-' THEN string_agg(s || '-' || e, ',' ORDER BY s DESC) ELSE {SPANS_SQL} END AS exons FROM ex GROUP BY tid, gene, lib, chrom, strand")
def normalised(v: View) -> DataFrame:
    rows = _features(v).withColumn("attrs", F.map_concat("attrs", F.create_map(F.lit("gene_type"), F.lit("lincRNA"), F.lit("source"), F.col("attrs")["lib"])))
    return fm.normalise_features(rows).withColumn("exons", spans())


@query("f1_by_attributes", "SELECT tid, s, e FROM ex WHERE lib = 'L3' AND gene <> 'G7'")
def by_attributes(v: View) -> DataFrame:
    rows = fl.by_attributes(_features(v), [("lib", "==", "L3"), ("gene_id", "!=", "G7"), ("absent", "!", "x")])
    return rows.select(F.col("attrs")["transcript_id"].cast("long").alias("tid"), "s", "e")


@query("f2_region", "SELECT tid, s, e FROM ex WHERE chrom = 'chr5' AND s < 500000 AND e > 100000")
def region(v: View) -> DataFrame:
    return fl.in_region(v.ex, "chr5", 100_000, 500_000).select("tid", "s", "e")


@query("f3_chroms", "SELECT chrom, count(*) AS n FROM ex WHERE chrom IN ('chr1', 'chr9') GROUP BY chrom")
def chroms(v: View) -> DataFrame:
    return fl.on_chroms(v.ex, ["chr1", "chr9"]).groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))


CLIP = """
r AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY s) AS n, count(*) OVER (PARTITION BY tid) AS m FROM ex),
a AS (SELECT *, CASE WHEN m > 1 AND n = 1 AND e - s < {x} THEN 1 ELSE 0 END AS cut1 FROM r),
b AS (SELECT *, max(cut1) OVER (PARTITION BY tid) AS c1 FROM a),
c AS (SELECT * FROM b WHERE cut1 = 0 AND NOT (m - c1 > 1 AND n = m AND e - s < {x})),
cl AS (SELECT tid, count(*) < any_value(m) AS clipped, CAST(sum(e - s) AS BIGINT) AS length, count(*) AS n_exons, min(s) AS s, max(e) AS e FROM c GROUP BY tid)"""


@query("f4_aggregate_filter", CLIP.format(x=350) + " SELECT tid, clipped, length, n_exons, s, e, length <= 700 AS too_short FROM cl")
def aggregate_filter(v: View) -> DataFrame:
    """A cut of 350 and a length of 700 suit these exons of 300 and 400."""
    return fl.aggregate_filter(v.tx, min_length=700, min_exon=350).select("tid", "clipped", "length", "n_exons", "s", "e", "too_short")


@query("f5_assembly_status", """SELECT tid, CASE WHEN ref THEN 'reference' WHEN strand = '.' AND n_exons > 1 THEN 'unstranded' WHEN length < 400 THEN 'short' ELSE 'ok' END AS status FROM tx""")
def assembly_status(v: View) -> DataFrame:
    return fl.assembly_status(v.tx, min_length=400).select("tid", "status")


@query("f6_noncoding", """SELECT tid FROM tx WHERE tid % 7 IN (1, 6) AND NOT (lib IN ('L1', 'L2')) AND length >= 600 AND n_exons >= 2 AND (tid % 5 = 0 OR (tid % 1000) >= 100)""")
def noncoding(v: View) -> DataFrame:
    category = F.element_at(F.array(*map(F.lit, ("a", "intergenic", "b", "c", "d", "e", "intronic"))), (F.col("tid") % 7 + 1).cast("int"))
    rows = v.tx.withColumn("category", category).withColumn("sources", F.concat(F.lit("x,"), F.col("lib"))).withColumn("distance", F.when(F.col("tid") % 5 != 0, F.col("tid") % 1000))
    return fl.noncoding(rows, ["intergenic", "intronic"], ["L1", "L2"], 600, 2, 100).select("tid")


@query("f7_biotype_ids", "SELECT DISTINCT tid FROM ex WHERE lib IN ('L4', 'L5')")
def biotype_ids(v: View) -> DataFrame:
    return v.ex.where(F.col("lib").isin("L4", "L5")).select("tid").distinct().orderBy("tid")


@query("f8_transcript_ids", "SELECT DISTINCT tid FROM ex")
def transcript_ids(v: View) -> DataFrame:
    return v.ex.select("tid").distinct()


@query("f9_modify_attributes", "SELECT tid, s, 'new' AS source, gene, 'yes' AS flag, false AS has_lib FROM ex")
def modify_attributes(v: View) -> DataFrame:
    rows = fl.set_source(fl.drop_attr(fl.set_attr(_features(v), "flag", "yes"), "lib"), "new")
    a = F.col("attrs")
    return rows.select(a["transcript_id"].cast("long").alias("tid"), "s", "source", a["gene_id"].alias("gene"), a["flag"].alias("flag"), F.map_contains_key("attrs", "lib").alias("has_lib"))


@query("f10_transcript_rows", "SELECT tid, chrom, strand, s, e, 'exon' AS feature_type FROM ex UNION ALL SELECT tid, chrom, strand, s, e, 'transcript' FROM tx")
def transcript_rows(v: View) -> DataFrame:
    return fl.transcript_rows(v.ex.withColumn("feature_type", F.lit("exon"))).select("tid", "chrom", "strand", "s", "e", "feature_type")


@query("f11_renumbered", """
k AS (SELECT gene, row_number() OVER (ORDER BY min({'chrom': chrom, 's': s, 'tid': tid}), gene) AS n FROM tx GROUP BY gene)
SELECT tid, gene, 'G' || lpad(CAST(n AS VARCHAR), 6, '0') AS gene_id FROM tx JOIN k USING (gene)""")
def renumbered(v: View) -> DataFrame:
    return fl.renumber(v.tx.select("tid", "gene", "chrom", "s"), "gene", ["chrom", "s", "tid"], "G", "gene_id", 6).select("tid", "gene", "gene_id")


@query("f12_tagged_tests", "SELECT tid, gene, ref, ref AND CAST('0x' || substr(md5('11:' || gene), 1, 15) AS BIGINT) % 1000000 < 200000 AS tst FROM tx")
def tagged_tests(v: View) -> DataFrame:
    return fl.tag_tests(v.tx, 0.2, seed=11).select("tid", "gene", "ref", "tst")


@query("f12_listed_tests", "SELECT tid, ref AND gene IN (SELECT gene FROM tx WHERE strand = '+' AND n_exons > 3) AS tst FROM tx")
def listed_tests(v: View) -> DataFrame:
    genes = v.tx.where("strand = '+' AND n_exons > 3").select("gene")
    return fl.tag_test_list(v.tx, genes).select("tid", "tst")


@query("f13_plain_chroms", "SELECT substr(chrom, 4) AS chrom, count(*) AS n FROM ex WHERE chrom <> 'chr22' GROUP BY 1")
def plain_chroms(v: View) -> DataFrame:
    names = {k: x for k, x in fl.CHROMS.items() if k != "chr22"}
    return fl.translate_chroms(v.ex, names=names).groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))


@query("f14_locus_strands", "SELECT chrom, locus, CASE WHEN count(DISTINCT strand) FILTER (strand <> '.') = 1 THEN min(strand) FILTER (strand <> '.') ELSE '.' END AS strand FROM lo GROUP BY chrom, locus")
def locus_strands(v: View) -> DataFrame:
    return v.lo.groupBy("chrom", "locus").agg(fl.merge_strand(F.collect_set("strand")).alias("strand"))


@query("f15_exploded", """SELECT tid, chrom, strand, 'transcript' AS feature_type, s, e, NULL::INT AS exon_number FROM tx
UNION ALL SELECT tid, chrom, strand, 'exon', s, e, CAST(row_number() OVER (PARTITION BY tid ORDER BY s, e) - 1 AS INT) FROM ex""")
def exploded(v: View) -> DataFrame:
    return fl.explode_transcripts(v.tx)
