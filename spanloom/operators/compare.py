"""Comparison of a set of transcripts with a reference set: pairwise matches, consensus, tallies, type imputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.operators.annotate import LOCUS, nodes
from spanloom.operators.components import components
from spanloom.operators.filters import global_rank, strands_agree
from spanloom.operators.intervals import introns, islands
from spanloom.operators.joins import nearest, overlap_join, shared_introns, splicing_patterns
from spanloom.sources.stages import stage

# Comparison categories, in the order in which choose_best prefers the last seven.
PREFERENCE = ("intronic_same_strand", "intronic_opp_strand", "interleaving_same_strand", "interleaving_opp_strand", "encompassing_same_strand", "encompassing_opp_strand", "intergenic")
#: Farthest neighbour that counts.
NEAR = 100_000_000


def locus_matches(tx: DataFrame, exon_rows: DataFrame) -> DataFrame:
    """One row per (tid, ref_id) of a locus that share or nest anything: shared bases by side, shared introns, splicing, category.

    Nodes are segments; a node inside or across an intron of the reference counts once per such intron, as hits. tx: chrom, locus, tid,
    strand, ref, gene, length, n_exons, s, e; exon_rows: chrom, locus, tid, strand, ref, s, e.
    """
    seg = stage(nodes(exon_rows.select(*LOCUS, "tid", "strand", "ref", "s", "e")), "nodes")
    t = seg.where("NOT ref").select(*LOCUS, "s", "e", "tid", "strand")
    r = seg.where("ref").select(*LOCUS, "s", "e", F.col("tid").alias("ref_id"), F.col("strand").alias("r_strand"))
    n = F.col("e") - F.col("s")
    agree = strands_agree(F.col("strand"), F.col("r_strand"))
    bases = t.join(r, [*LOCUS, "s", "e"]).groupBy("tid", "ref_id").agg(F.sum(F.when(agree, n).otherwise(0)).alias("same_bp"), F.sum(F.when(~agree, n).otherwise(0)).alias("opp_bp"))
    gaps = introns(exon_rows.select(*LOCUS, "tid", "strand", "ref", "s", "e"), [*LOCUS, "tid", "strand", "ref"])
    r_gaps = gaps.where("ref").select(*LOCUS, F.col("tid").alias("ref_id"), F.col("strand").alias("r_strand"), F.col("s").alias("i_s"), F.col("e").alias("i_e"))
    inside = t.join(r_gaps, LOCUS).where("s < i_e AND i_s < e").groupBy("tid", "ref_id").agg(F.count_if(agree).alias("in_same"), F.count_if(~agree).alias("in_opp"))
    t_gaps = gaps.where("NOT ref").select(*LOCUS, "strand", "tid", "s", "e")
    shared = t_gaps.join(gaps.where("ref").select(*LOCUS, "strand", F.col("tid").alias("ref_id"), "s", "e"), [*LOCUS, "strand", "s", "e"]).groupBy("tid", "ref_id").agg(F.count(F.lit(1)).alias("shared_introns"))
    pattern = lambda ref: splicing_patterns(gaps.where("ref" if ref else "NOT ref").select("tid", "chrom", "strand", "s", "e"))
    same_pattern = pattern(False).join(pattern(True).withColumnRenamed("tid", "ref_id"), ["chrom", "strand", "pattern"]).select("tid", "ref_id", F.lit(True).alias("splicing"))
    out = bases
    for other in (inside, shared, same_pattern):
        out = out.join(other, ["tid", "ref_id"], "full")
    out = out.na.fill(0).na.fill(False, ["splicing"])
    count = t.groupBy("tid").agg(F.count(F.lit(1)).alias("n_nodes"))
    facts = lambda df, pre: df.select(F.col("tid").alias("tid" if pre == "" else "ref_id"), *(F.col(c).alias(f"{pre}{c}") for c in ("gene", "length", "n_exons", "chrom", "s", "e", "strand")))
    out = out.join(count, "tid").join(facts(tx.where("NOT ref"), ""), "tid").join(facts(tx.where("ref"), "ref_"), "ref_id")
    all_in = F.col("in_same") + F.col("in_opp") == F.col("n_nodes")
    same = F.col("in_same") > 0
    category = (
        F.when(F.col("splicing") | (F.col("shared_introns") > 0) | (F.col("same_bp") > 0), "same_strand")
        .when(F.col("opp_bp") > 0, "opp_strand")
        .when(all_in, F.when(same, "intronic_same_strand").otherwise("intronic_opp_strand"))
        .otherwise(F.when(same, "interleaving_same_strand").otherwise("interleaving_opp_strand"))
    )
    return out.withColumn("category", category).withColumn("distance", F.lit(0).cast("long")).drop("n_nodes")


def _preference() -> list[Column]:
    """Sort keys of the best match, best first."""
    all_introns = F.col("n_exons") - 1 + F.col("ref_n_exons") - 1
    part = lambda x, total: F.when(total > 0, x / (total - x)).otherwise(0.0)
    total = F.col("length") + F.col("ref_length")
    keys = [F.col("splicing").cast("int"), part(F.col("shared_introns"), all_introns), part(F.col("same_bp"), total), part(F.col("opp_bp"), total)]
    keys += [(F.col("category") == c).cast("int") for c in PREFERENCE] + [-F.abs("distance")]
    return [k.desc() for k in keys] + [F.col("ref_id").asc()]


def choose_best(matches: DataFrame, *by: str) -> DataFrame:
    """The best match of each group: splicing, intron share, same-strand share, opposite share, category, nearness, then ref_id."""
    return matches.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*_preference()))).where("_r = 1").drop("_r")


def consensus(matches: DataFrame) -> DataFrame:
    """(tid, category, ref_ids, ref_genes, shared_introns, same_bp, splicing): same-strand matches are merged over genes (the best of each, in genome
    order, reversed if any is on -), read_through for more than one gene; without any, the best match alone."""
    matches = stage(matches, "matches")  # read twice below
    same = choose_best(matches.where("category = 'same_strand'"), "tid", "ref_gene")
    entry = F.struct("ref_chrom", "ref_s", "ref_e", "ref_id", "ref_gene")
    merged = same.groupBy("tid").agg(F.array_sort(F.collect_list(entry)).alias("hits"), F.max(F.col("ref_strand") == "-").alias("minus"), F.sum("shared_introns").alias("shared_introns"), F.sum("same_bp").alias("same_bp"), F.max("splicing").alias("splicing"))
    merged = merged.withColumn("hits", F.when(F.col("minus"), F.reverse("hits")).otherwise(F.col("hits")))
    csv = lambda field: F.array_join(F.transform("hits", lambda h: h[field].cast("string")), ",")
    first = merged.select("tid", F.when(F.size("hits") > 1, "read_through").otherwise("same_strand").alias("category"), csv("ref_id").alias("ref_ids"), csv("ref_gene").alias("ref_genes"), "shared_introns", "same_bp", "splicing")
    rest = choose_best(matches.join(merged.select("tid"), "tid", "left_anti"), "tid")
    return first.unionByName(rest.select("tid", "category", F.col("ref_id").cast("string").alias("ref_ids"), F.col("ref_gene").alias("ref_genes"), "shared_introns", "same_bp", "splicing"))


def reference_loci(tx: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Loci of the references alone: (chrom, ref_locus, s, e), and their members (ref_locus, ref_id, r_strand, r_s, r_e)."""
    placed = islands(tx.where("ref").select("chrom", "tid", "strand", "s", "e"), ["chrom"], order=["tid"], out="no")
    placed = placed.withColumn("ref_locus", F.concat_ws(":", "chrom", F.col("no").cast("string")))
    loci = placed.groupBy("chrom", "ref_locus").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return loci, placed.select("ref_locus", F.col("tid").alias("ref_id"), F.col("strand").alias("r_strand"), F.col("s").alias("r_s"), F.col("e").alias("r_e"))


def intergenic_matches(asks: DataFrame, tx: DataFrame, max_dist: int = NEAR) -> DataFrame:
    """(tid, side, ref_id, category, distance) of asks (chrom, tid, strand, s, e): members of the reference loci that overlap the span (side within,
    encompassing, distance 0), and of the nearest ones on each side (intergenic, each member's own distance)."""
    loci, members = reference_loci(tx)
    loci, members = stage(loci, "reference-loci"), stage(members, "reference-members")
    asks = asks.select("chrom", "tid", "strand", "s", "e")
    sides = [nearest(asks.select("chrom", "tid", "s", "e"), loci, "chrom", side, max_dist, "tid", "ref_locus").select("tid", F.lit(side).alias("side"), "ref_locus") for side in ("left", "right")]
    inside = overlap_join(asks.select("chrom", "tid", "s", "e"), loci, ["chrom"]).select("tid", F.lit("within").alias("side"), F.col("b_ref_locus").alias("ref_locus"))
    found = sides[0].unionByName(sides[1]).unionByName(inside).join(members, "ref_locus").join(asks.select("tid", "strand", "s", "e"), "tid")
    agree = strands_agree(F.col("strand"), F.col("r_strand"))
    category = F.when(F.col("side") != "within", "intergenic").when(agree, "encompassing_same_strand").otherwise("encompassing_opp_strand")
    distance = F.when(F.col("side") == "within", 0).otherwise(F.least(F.abs(F.col("s") - F.col("r_e")), F.abs(F.col("r_s") - F.col("e"))))
    return found.select("tid", "side", "ref_id", category.alias("category"), distance.cast("long").alias("distance"))


def compare(tx: DataFrame, exon_rows: DataFrame) -> DataFrame:
    """(tid, category, ref_ids) of every non-reference transcript: the consensus of its matches in the locus, else the best of what is around, else
    intergenic with no reference."""
    overlapping = stage(consensus(locus_matches(tx, exon_rows)).select("tid", "category", "ref_ids"), "consensus")
    asks = tx.where("NOT ref").join(overlapping.select("tid"), "tid", "left_anti")
    around = intergenic_matches(asks, tx)
    facts = lambda ref: tx.where("ref" if ref else "NOT ref").select(F.col("tid").alias("ref_id" if ref else "tid"), F.col("length").alias("ref_length" if ref else "length"), F.col("n_exons").alias("ref_n_exons" if ref else "n_exons"))
    full = around.join(facts(False), "tid").join(facts(True), "ref_id")
    for c in ("same_bp", "opp_bp", "shared_introns"):
        full = full.withColumn(c, F.lit(0))
    best = choose_best(full.withColumn("splicing", F.lit(False)), "tid").select("tid", "category", F.col("ref_id").cast("string").alias("ref_ids"))
    rest = asks.select("tid").join(best, "tid", "left").select("tid", F.coalesce("category", F.lit("intergenic")).alias("category"), "ref_ids")
    return overlapping.unionByName(rest)


def nearest_genes(tx: DataFrame, max_dist: int = 1_000_000) -> DataFrame:
    """(tid, left_gene, left_dist, right_gene, right_dist): nearest reference genes; -1 and NA if none."""
    genes = tx.where("ref").groupBy("chrom", "gene").agg(F.min("s").alias("s"), F.max("e").alias("e")).withColumnRenamed("gene", "near_gene")
    asks = tx.where("NOT ref").select("chrom", "tid", "s", "e")
    out = asks.select("tid")
    for side in ("left", "right"):
        near = nearest(asks, genes, "chrom", side, max_dist, "tid", "near_gene").select("tid", F.col("near_gene").alias(f"{side}_gene"), F.col("dist").alias(f"{side}_dist"))
        out = out.join(near, "tid", "left")
    return out.na.fill("NA", ["left_gene", "right_gene"]).na.fill(-1, ["left_dist", "right_dist"])


def _items(exon_rows: DataFrame) -> DataFrame:
    """(what, item, ref, tid, w): each transcript's introns, its splicing pattern, and its nodes weighted by their bases. An unstranded node stands for the
    nodes of both strands where they exist."""
    place = lambda *cols: F.concat_ws(":", *(F.col(c).cast("string") for c in cols)).alias("item")
    gaps = introns(exon_rows.select("chrom", "tid", "strand", "ref", "s", "e"), ["chrom", "tid", "strand", "ref"])
    one = gaps.select(F.lit("introns").alias("what"), place("chrom", "strand", "s", "e"), "ref", "tid", F.lit(1).cast("long").alias("w"))
    sides = splicing_patterns(gaps.where("ref")).withColumn("ref", F.lit(True)).unionByName(splicing_patterns(gaps.where("NOT ref")).withColumn("ref", F.lit(False)))
    two = sides.select(F.lit("patterns").alias("what"), place("chrom", "strand", "pattern"), "ref", "tid", F.lit(1).cast("long").alias("w"))
    key = [*LOCUS, "s", "e"]
    seg = nodes(exon_rows.select(*LOCUS, "tid", "strand", "ref", "s", "e"))
    known = seg.where("strand <> '.'").select(*key, "strand").distinct()
    spread = seg.where("strand = '.'").select(*key, "ref", "tid").join(known, key, "left").select(*key, F.coalesce("strand", F.lit(".")).alias("strand"), "ref", "tid")
    both = seg.where("strand <> '.'").select(*key, "strand", "ref", "tid").unionByName(spread)
    three = both.select(F.lit("bases").alias("what"), place(*key, "strand"), "ref", "tid", (F.col("e") - F.col("s")).alias("w"))
    return one.unionByName(two).unionByName(three)


def tallies(exon_rows: DataFrame) -> DataFrame:
    """(what, both, ref_only, test_only, precision, recall): introns, splicing patterns and bases in both sets or in one."""
    sides = _items(exon_rows).groupBy("what", "item").agg(F.max("ref").alias("r"), F.max(~F.col("ref")).alias("t"), F.max("w").alias("w"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("w"))), F.lit(0)).cast("long")
    r, t = F.col("r"), F.col("t")
    rows = sides.groupBy("what").agg(total(r & t).alias("both"), total(r & ~t).alias("ref_only"), total(t & ~r).alias("test_only"))
    share = lambda c: F.round(F.col("both") / F.greatest(F.lit(1), F.col("both") + F.col(c)), 6)
    return rows.withColumn("precision", share("test_only")).withColumn("recall", share("ref_only"))


def tallies_by_category(exon_rows: DataFrame, categories: DataFrame) -> DataFrame:
    """(what, category, n): items of the non-reference set by the category (tid, category) of their transcript, the smallest tid for shared items."""
    mine = _items(exon_rows).where("NOT ref").join(categories, "tid").groupBy("what", "item").agg(F.min_by("category", "tid").alias("category"), F.max("w").alias("w"))
    return mine.groupBy("what", "category").agg(F.sum("w").alias("n"))


def impute_type(category: Column, ref_type: Column, length: Column) -> Column:
    """Gene type of a compared transcript: the reference's on the same strand (protein_coding stays), misc_RNA if short, else by category, else lincRNA."""
    table = F.create_map(*(F.lit(x) for kv in (("opp_strand", "antisense"), ("intronic_same_strand", "sense_intronic"), ("intronic_opp_strand", "antisense"), ("interleaving_same_strand", "sense_overlapping"), ("interleaving_opp_strand", "antisense"), ("encompassing_same_strand", "sense_overlapping"), ("encompassing_opp_strand", "antisense")) for x in kv))
    return F.when(category.isin("same_strand", "read_through"), ref_type).when(length < 250, "misc_RNA").otherwise(F.coalesce(F.try_element_at(table, category), F.lit("lincRNA")))


def type_class(gene_type: Column) -> Column:
    """Class of a gene type."""
    return F.when(gene_type == "protein_coding", "protein").when(gene_type.contains("pseudogene"), "pseudogene").when(gene_type.isin("misc_RNA", "snRNA", "snoRNA", "rRNA", "miRNA"), "small").otherwise("lncrna")


def coding_category(tx: DataFrame, exon_rows: DataFrame, ref_types: DataFrame) -> DataFrame:
    """(tid, label) of non-reference transcripts: protein, ncrna, antisense, intronic or intergenic, in this order of priority. ref_types: tid, coding."""
    refs = exon_rows.where("ref").join(ref_types, "tid").select("chrom", "s", "e", "strand", "coding")
    asks = exon_rows.where("NOT ref").select("chrom", "s", "e", "tid", "strand")
    hits = overlap_join(asks, refs, ["chrom"])
    agree = strands_agree(F.col("strand"), F.col("b_strand"))
    exonic = hits.groupBy("tid").agg(F.max(agree & F.col("b_coding")).alias("p"), F.max(agree & ~F.col("b_coding")).alias("n"), F.max(~agree).alias("a"))
    spans = tx.where("ref").select("chrom", "s", "e")
    within = overlap_join(tx.where("NOT ref").select("chrom", "s", "e", "tid"), spans, ["chrom"]).select("tid").distinct().withColumn("w", F.lit(True))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    label = F.when(yes("p"), "protein").when(yes("n"), "ncrna").when(yes("a"), "antisense").when(yes("w"), "intronic").otherwise("intergenic")
    return tx.where("NOT ref").select("tid").join(exonic, "tid", "left").join(within, "tid", "left").select("tid", label.alias("label"))


def best_in_both_directions(exon_rows: DataFrame) -> DataFrame:
    """(direction, tid, match, same_pattern, introns, bases): on equal strands, the best partner of each transcript in the other set by splicing pattern,
    then shared introns, then shared bases; ties to the larger id."""
    gaps = introns(exon_rows.select("chrom", "tid", "strand", "ref", "s", "e"), ["chrom", "tid", "strand", "ref"])
    pat = lambda ref: splicing_patterns(gaps.where("ref" if ref else "NOT ref").select("tid", "chrom", "strand", "s", "e"))
    seg = nodes(exon_rows.select(*LOCUS, "tid", "strand", "ref", "s", "e"))
    side = lambda df, ref, name: df.where("ref" if ref else "NOT ref").withColumnRenamed("tid", name).drop("ref")
    bases = side(seg, False, "t").join(side(seg, True, "r"), [*LOCUS, "strand", "s", "e"]).groupBy("t", "r").agg(F.sum(F.col("e") - F.col("s")).alias("bases"))
    shared = side(gaps, False, "t").join(side(gaps, True, "r"), ["chrom", "strand", "s", "e"]).groupBy("t", "r").agg(F.count(F.lit(1)).alias("introns"))
    same = pat(False).withColumnRenamed("tid", "t").join(pat(True).withColumnRenamed("tid", "r"), ["chrom", "strand", "pattern"]).select("t", "r", F.lit(1).alias("same_pattern"))
    pairs = bases.join(shared, ["t", "r"], "full").join(same, ["t", "r"], "full").na.fill(0)
    keys = [F.desc("same_pattern"), F.desc("introns"), F.desc("bases")]
    out = None
    for a, b, name in (("t", "r", "test_to_ref"), ("r", "t", "ref_to_test")):
        best = pairs.withColumn("_n", F.row_number().over(W.partitionBy(a).orderBy(*keys, F.desc(b)))).where("_n = 1")
        rows = best.select(F.lit(name).alias("direction"), F.col(a).alias("tid"), F.col(b).alias("match"), "same_pattern", "introns", "bases")
        out = rows if out is None else out.unionByName(rows)
    return out


def merge_genes(exon_rows: DataFrame) -> DataFrame:
    """(tid, gene_id, gene): transcripts whose exons share a cluster (chromosome and strand, touching merges), transitively, are one gene; gene ids
    number the genes by place. Rounds grow with the logarithm of the longest chain of clusters."""
    rows = islands(exon_rows.select("chrom", "strand", "tid", "gene", "s", "e"), ["chrom", "strand"], order=["tid"])
    links = stage(rows.select("chrom", "strand", "island", "tid").distinct(), "cluster-members")
    hubs = links.groupBy("chrom", "strand", "island").agg(F.min("tid").alias("v"))
    edges = links.join(hubs, ["chrom", "strand", "island"]).select(F.col("tid").alias("u"), "v")
    linked = components(edges).withColumnRenamed("node", "tid")
    label = links.select("tid").distinct().join(linked, "tid", "left").select("tid", F.coalesce("component", "tid").alias("g"))
    places = exon_rows.join(label, "tid").groupBy("g").agg(F.min(F.struct("chrom", "s", "e", "strand")).alias("place"))
    named = global_rank(places, ["place", "g"], "no").select("g", F.format_string("source%011d", "no").alias("gene_id"))
    return label.join(named, "g").join(exon_rows.select("tid", "gene").distinct(), "tid").select("tid", "gene_id", "gene")


def best_tuples(exon_rows: DataFrame) -> DataFrame:
    """(tid, ref_id, pattern, introns, overlap): for each transcript that isn't a reference the reference of its strand that it overlaps with the
    greatest (same splicing pattern, shared introns, shared exonic bases), the smaller id among equals. exon_rows: chrom, strand, tid, ref, s, e."""
    spans = exon_rows.select("chrom", "strand", "tid", "ref", "s", "e")
    met = overlap_join(spans.where("NOT ref").drop("ref"), spans.where("ref").drop("ref"), ["chrom", "strand"])
    shared = met.groupBy("tid", "b_tid").agg(F.sum(F.least("e", "b_e") - F.greatest("s", "b_s")).alias("overlap"))
    gaps = introns(spans, ["chrom", "tid", "strand", "ref"])
    both = shared_introns(gaps.where("NOT ref"), gaps.where("ref")).select(F.col("a_tid").alias("tid"), "b_tid", F.col("n").alias("introns"))
    whole = splicing_patterns(gaps).select("tid", F.concat_ws(" ", "chrom", "strand", "pattern").alias("pattern"))
    all_pairs = shared.join(both, ["tid", "b_tid"], "left").join(whole.withColumnRenamed("pattern", "_p"), "tid", "left").join(whole.toDF("b_tid", "_q"), "b_tid", "left")
    rank = F.struct(F.coalesce(F.col("_p") == F.col("_q"), F.lit(False)).alias("pattern"), F.coalesce("introns", F.lit(0)).alias("introns"), "overlap", (-F.col("b_tid")).alias("_least"))
    return all_pairs.groupBy("tid").agg(F.max_by("b_tid", rank).alias("ref_id"), F.max(rank).alias("_r")).select("tid", "ref_id", "_r.pattern", "_r.introns", "_r.overlap")
