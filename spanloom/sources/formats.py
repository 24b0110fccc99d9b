"""GTF, BED, genePred, bedGraph, FASTA and small tables: lines to rows and rows to lines.

Readers take a DataFrame of lines (``value``), as spark.read.text gives it, so any store and compression works and files split across
tasks; writers return one. Positions are 0-based half-open in tables, and whatever the format asks for in lines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.operators.filters import global_rank


def parse_gtf(lines: DataFrame, numbers: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """seqid, source, feature_type, s, e, score (0 for .), strand (. for anything but + and -), phase, attrs; attributes named in numbers become columns
    of doubles. Blank lines and comments are skipped; columns of keep come along."""
    f = F.split("value", "\t")
    rows = lines.where("trim(value) <> '' AND NOT value LIKE '#%'")
    pairs = F.transform(F.regexp_extract_all(f[8], F.lit(r'(\S+ "[^"]*")'), F.lit(1)), lambda p: F.struct(F.substring_index(p, " ", 1), F.regexp_extract(p, '"([^"]*)"', 1)))
    unique = F.map_from_arrays(F.transform(pairs, lambda p: p["col1"]), F.transform(pairs, lambda p: p["col2"]))
    strand = F.when(f[6].isin("+", "-"), f[6]).otherwise(".")
    out = rows.select(*keep, f[0].alias("seqid"), f[1].alias("source"), f[2].alias("feature_type"), (f[3].cast("long") - 1).alias("s"), f[4].cast("long").alias("e"), F.when(f[5] == ".", 0.0).otherwise(f[5].try_cast("double")).alias("score"), strand.alias("strand"), f[7].alias("phase"), unique.alias("attrs"))
    return out.select("*", *(F.col("attrs")[k].try_cast("double").alias(k) for k in numbers))


def _corrupt(value: Column) -> Column:
    """Whether a line isn't nine fields with a start of 1 or more and an end at or behind it."""
    f = F.split(value, "\t")
    start, end = F.get(f, 3).try_cast("long"), F.get(f, 4).try_cast("long")
    return ~F.coalesce((F.size(f) == 9) & (start >= 1) & (end >= start), F.lit(False))


def read_libraries(spark: SparkSession, libraries: DataFrame, numbers: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """libraries (library_id, sample_id, gtf_file: a file, or a folder of files) -> the features of all their files, with library_id and sample_id; and
    the lines that can't be read: library_id, file, value.

    The paths of the table, a row a library, are listed by the driver; files are read by Spark in splits, from any store that it reads. A
    missing file is an error; a table without rows gives no features; a null gtf_file is left out.
    """
    listed = libraries.where("gtf_file IS NOT NULL").select("library_id", "sample_id", "gtf_file").collect()
    hadoop = spark._jsc.hadoopConfiguration()

    def whole(path: str) -> str:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(hadoop).makeQualified(at).toUri().toString()

    plain = lambda c: F.regexp_replace(c, r"^(\w+):/+", "$1:/")
    text = spark.read.text(sorted({r["gtf_file"] for r in listed})) if listed else spark.createDataFrame([], "value string")
    file = F.col("_metadata.file_path") if listed else F.lit("")
    table = spark.createDataFrame([(whole(r["gtf_file"]), r["library_id"], r["sample_id"]) for r in listed], "_at string, library_id string, sample_id string").withColumn("_at", plain("_at"))
    lines = text.where("trim(value) <> '' AND NOT value LIKE '#%'").select("value", plain(file).alias("file")).withColumn("_at", F.col("file"))
    folder = F.regexp_replace("file", r"/[^/]*$", "")
    # A row a library: Spark broadcasts the table where it is small.
    named = lines.join(table, "_at").unionByName(lines.withColumn("_at", folder).join(table, "_at"))
    good = named.where(~_corrupt(F.col("value")))
    features = parse_gtf(good, numbers, keep=["library_id", "sample_id"])
    return features, named.where(_corrupt(F.col("value"))).select("library_id", "file", "value")


def gtf_line(seqid: Column, source: Column, kind: Column, s: Column, e: Column, score: Column, strand: Column, attrs: Sequence[tuple[str, Column]]) -> Column:
    tail = F.concat_ws(" ", *(F.concat(F.lit(f'{k} "'), v.cast("string"), F.lit('";')) for k, v in attrs))
    return F.concat_ws("\t", seqid, source, kind, (s + 1).cast("string"), e.cast("string"), score.cast("string"), strand, F.lit("."), tail)


def gtf_lines(tx: DataFrame, source: str = "spanloom", first_exon: int = 1, keep: Sequence[str] = ()) -> DataFrame:
    """value: a transcript line and its exon lines for each row of tx (tid, gene, chrom, strand, score, s, e, exons), exons numbered from first_exon;
    before it the columns of keep."""
    base = [("gene_id", F.col("gene")), ("transcript_id", F.col("tid"))]
    head = gtf_line(F.col("chrom"), F.lit(source), F.lit("transcript"), F.col("s"), F.col("e"), F.col("score"), F.col("strand"), base)
    exon = F.transform("exons", lambda x, i: gtf_line(F.col("chrom"), F.lit(source), F.lit("exon"), x["s"], x["e"], F.col("score"), F.col("strand"), [*base, ("exon_number", i + first_exon)]))
    return tx.select(*keep, F.explode(F.concat(F.array(head), exon)).alias("value"))


def sort_gtf(rows: DataFrame) -> DataFrame:
    """By chromosome bytes, start, and type descending, so that a transcript precedes its exons."""
    return rows.orderBy("seqid", "s", F.desc("feature_type"))


def nest_transcripts(features: DataFrame) -> DataFrame:
    """Exon feature rows with attrs to one row per transcript: tid, gene, chrom, strand, s, e, exons."""
    exon = features.where("feature_type = 'exon'")
    return exon.groupBy(F.col("attrs")["transcript_id"].alias("tid")).agg(F.min(F.col("attrs")["gene_id"]).alias("gene"), F.min("seqid").alias("chrom"), F.min("strand").alias("strand"), F.min("s").alias("s"), F.max("e").alias("e"), F.sort_array(F.collect_list(F.struct("s", "e"))).alias("exons"))


def parse_bed(lines: DataFrame, default_name: str = "plain") -> DataFrame:
    """chrom, s, e, name, score, strand, exons, extra. Lines of 3, 4, 6 or 12 and more columns; missing names are 'chrom:s-e' (default_name 'place') or '.'; without
    blocks the interval is the only exon; columns after 12 stay in extra."""
    f = F.split("value", "\t")
    n = F.size(f)
    rows = lines.where("trim(value) <> '' AND NOT value LIKE '#%' AND NOT value LIKE 'track%'")
    s, e = f[1].cast("long"), f[2].cast("long")
    none = F.concat(f[0], F.lit(":"), f[1], F.lit("-"), f[2]) if default_name == "place" else F.lit(".")
    ints = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("long"))
    blocks = F.zip_with(ints(F.get(f, 10)), ints(F.get(f, 11)), lambda size, start: F.struct((s + start).alias("s"), (s + start + size).alias("e")))
    one = F.array(F.struct(s.alias("s"), e.alias("e")))
    return rows.select(f[0].alias("chrom"), s.alias("s"), e.alias("e"), F.when(n > 3, F.get(f, 3)).otherwise(none).alias("name"), F.when(n > 4, F.get(f, 4).try_cast("double")).otherwise(0.0).alias("score"), F.when(n > 5, F.get(f, 5)).otherwise(".").alias("strand"), F.when(n >= 12, blocks).otherwise(one).alias("exons"), F.when(n > 12, F.slice(f, 13, 1 << 20)).otherwise(F.array().cast("array<string>")).alias("extra"))


def bed12_line(chrom: Column, s: Column, e: Column, name: Column, score: Column, strand: Column, exons: Column) -> Column:
    sizes = F.array_join(F.transform(exons, lambda x: (x["e"] - x["s"]).cast("string")), ",")
    starts = F.array_join(F.transform(exons, lambda x: (x["s"] - s).cast("string")), ",")
    cells = (chrom, s, e, name, score, strand, s, s, F.lit("0"), F.size(exons), sizes, starts)
    return F.concat_ws("\t", *(c.cast("string") for c in cells))


def bed_lines(tx: DataFrame, with_gene: bool = False) -> DataFrame:
    name = F.concat_ws("|", "gene", F.col("tid").cast("string")) if with_gene else F.col("tid").cast("string")
    return tx.select(bed12_line(F.col("chrom"), F.col("s"), F.col("e"), name, F.col("score"), F.col("strand"), F.col("exons")).alias("value"))


def bed_to_features(bed: DataFrame) -> DataFrame:
    """Transcript and exon feature rows of BED rows; exon_number counts from 0, null on transcripts."""
    cols = ["chrom", "name", "strand"]
    exon = bed.select(*cols, F.posexplode("exons").alias("exon_number", "x")).select(*cols, F.lit("exon").alias("feature_type"), F.col("x.s").alias("s"), F.col("x.e").alias("e"), "exon_number")
    return bed.select(*cols, F.lit("transcript").alias("feature_type"), "s", "e", F.lit(None).cast("int").alias("exon_number")).unionByName(exon)


def parse_genepred(lines: DataFrame) -> DataFrame:
    """name, chrom, strand, s, e, gene_type (coding if the coding span isn't empty), exons; a repeated name becomes name.1, name.2 by place."""
    f = F.split("value", "\t")
    ints = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("long"))
    rows = lines.where("trim(value) <> '' AND NOT value LIKE '#%'").select(f[0].alias("name"), f[1].alias("chrom"), f[2].alias("strand"), f[3].cast("long").alias("s"), f[4].cast("long").alias("e"), F.when(f[5] != f[6], "protein_coding").otherwise("noncoding").alias("gene_type"), F.arrays_zip(ints(f[8]).alias("s"), ints(f[9]).alias("e")).alias("exons"))
    n = F.row_number().over(W.partitionBy("name").orderBy("chrom", "s", "e", "strand")) - 1
    return rows.withColumn("name", F.when(n > 0, F.concat_ws(".", "name", n.cast("string"))).otherwise(F.col("name")))


def genepred_line(tx_cols: Sequence[Column], exons: Column) -> Column:
    """name, chrom, strand, s, e, coding start, coding end, then exon count and lists."""
    listed = lambda field: F.concat(F.array_join(F.transform(exons, lambda x: x[field].cast("string")), ","), F.lit(","))
    return F.concat_ws("\t", *(c.cast("string") for c in (*tx_cols, F.size(exons), listed("s"), listed("e"))))


def bedgraph_lines(nodes: DataFrame, strand: str) -> DataFrame:
    """value: chrom, start, end, score of the nodes of one strand."""
    return nodes.where(F.col("strand") == strand).select(F.concat_ws("\t", "chrom", *(F.col(c).cast("string") for c in ("s", "e", "score"))).alias("value"))


def track_line(name: str, kind: str, url: str, color: str = "0,0,0") -> str:
    """Browser track definition for a file at url."""
    return f'track type={kind} name="{name}" description="{name}" visibility=full color={color} bigDataUrl={url}'


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table whose header names its columns, in any order."""
    return spark.read.option("header", True).option("sep", "\t").csv(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("sep", "\t").mode("overwrite").csv(path)


def write_split(df: DataFrame, path: str, key: str) -> None:
    """One folder per value of key; rows without it go to na_missing."""
    df.withColumn(key, F.coalesce(F.col(key), F.lit("na_missing"))).write.partitionBy(key).mode("overwrite").parquet(path)


def fasta_records(df: DataFrame, name: str = "name", seq: str = "seq", keep: Sequence[str] = ()) -> DataFrame:
    """value: two-line records, after the columns of keep."""
    return df.select(*keep, F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.col(seq)).alias("value"))


def split_fasta(records: DataFrame, n: int, path: str, order: Sequence[str]) -> None:
    """records (value, and the columns of order, which is total) dealt in turn: the k-th to folder part=k % n below path, a file each, in order."""
    dealt = global_rank(records, order, "_no", 0).withColumn("part", F.col("_no") % n)
    dealt.repartition(n, "part").sortWithinPartitions("part", "_no").select("value", "part").write.partitionBy("part").mode("overwrite").text(path)


def read_split_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(part, name, seq): the two-line records of split_fasta."""
    lines = spark.read.option("lineSep", "\n>").text(path)
    value = F.regexp_replace("value", r"^>|\n$", "")
    return lines.select(F.col("part").cast("long").alias("part"), F.substring_index(value, "\n", 1).alias("name"), F.regexp_extract(value, r"(?s)^[^\n]*\n(.*)$", 1).alias("seq"))


def parse_tracking(lines: DataFrame) -> DataFrame:
    """tid, length, fpkm of a tracking table's data lines (tid, length, fpkm, status): fpkm is null unless the status is OK."""
    f = F.split("value", "\t")
    return lines.select(f[0].alias("tid"), f[1].cast("long").alias("length"), F.when(f[3] == "OK", f[2].try_cast("double")).alias("fpkm"))


def map_mass(lines: DataFrame) -> DataFrame:
    """The normalized map masses that a log names."""
    return lines.select(F.regexp_extract("value", r"Normalized Map Mass:\s*([0-9.]+)", 1).try_cast("double").alias("mass")).where("mass IS NOT NULL")


#: Rows of a count file that are no features.
SPECIAL_COUNTS = ("no_feature", "ambiguous", "too_low_aQual", "not_aligned", "alignment_not_unique")


def parse_counts(lines: DataFrame) -> DataFrame:
    """name, n, special of count lines."""
    f = F.split("value", "\t")
    return lines.select(f[0].alias("name"), f[1].cast("long").alias("n"), f[0].isin(*SPECIAL_COUNTS).alias("special"))


def parse_junctions(lines: DataFrame) -> DataFrame:
    """chrom, left, right, strand of raw junction lines: left is the last base before the gap, right the first after it."""
    f = F.split("value", "\t")
    return lines.select(f[0].alias("chrom"), f[1].cast("long").alias("left"), f[2].cast("long").alias("right"), f[3].alias("strand"))


def bed_junctions(bed: DataFrame) -> DataFrame:
    """chrom, left, right, strand of the gaps between blocks: left = end of a block - 1."""
    gaps = F.zip_with(F.slice("exons", F.lit(1), F.size("exons") - 1), F.slice("exons", 2, 1 << 20), lambda a, b: F.struct((a["e"] - 1).alias("left"), b["s"].alias("right")))
    return bed.where(F.size("exons") > 1).select("chrom", "strand", F.explode(gaps).alias("g")).select("chrom", "g.left", "g.right", "strand")


def unpaired_flags(df: DataFrame, flag: str = "flag") -> DataFrame:
    """Alignment flags without the bits of pairing; the mate's reference is -1."""
    return df.withColumn(flag, F.col(flag).bitwiseAND(0b1111111100010100)).withColumn("rnext", F.lit(-1))


def normalise_features(features: DataFrame) -> DataFrame:
    """Exon rows of mixed origin to one row per transcript: gene_name falls back to gene_id, the source attribute to the source column, the span comes from the
    exons, which stand in transcription order. Rows without a gene_type are rejected when read."""
    a = F.col("attrs")
    exon = features.where("feature_type = 'exon'").select(a["transcript_id"].alias("tid"), a["gene_id"].alias("gene_id"), F.coalesce(a["gene_name"], a["gene_id"]).alias("gene_name"), F.coalesce(a["source"], F.col("source")).alias("source"), F.coalesce(a["gene_type"], F.raise_error(F.lit("a row has no gene_type"))).alias("gene_type"), F.col("seqid").alias("chrom"), "strand", "s", "e")
    whole = exon.groupBy("tid").agg(*(F.min(c).alias(c) for c in ("gene_id", "gene_name", "source", "gene_type", "chrom", "strand")), F.min("s").alias("s"), F.max("e").alias("e"), F.sort_array(F.collect_list(F.struct("s", "e"))).alias("exons"))
    return whole.withColumn("exons", F.when(F.col("strand") == "-", F.reverse("exons")).otherwise(F.col("exons")))


def metadata_table(exon_rows: DataFrame) -> DataFrame:
    """transcript_id, chrom, s, e, strand, num_exons, transcript_length, gene of each transcript (attributes of its first exon)."""
    first = lambda c: F.min_by(c, F.struct("s", "e"))
    return exon_rows.groupBy(F.col("tid").alias("transcript_id")).agg(first("chrom").alias("chrom"), F.min("s").alias("s"), F.max("e").alias("e"), first("strand").alias("strand"), F.count(F.lit(1)).alias("num_exons"), F.sum(F.col("e") - F.col("s")).alias("transcript_length"), first("gene").alias("gene"))
