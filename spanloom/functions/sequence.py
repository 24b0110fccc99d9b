"""Sequence functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# IUPAC codes and their complements, and the standard genetic code in TCAG order.
_DNA, _DNA_C = "ACGTRYSWKMBDHVNacgtryswkmbdhvn", "TGCAYRSWMKVHDBNtgcayrswmkvhdbn"
_AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def complement(seq: Column, rna: bool = False) -> Column:
    a, b = (_DNA, _DNA_C) if not rna else (_DNA.replace("T", "U").replace("t", "u"), _DNA_C.replace("T", "U").replace("t", "u"))
    return F.translate(seq, a, b)


def reverse_complement(seq: Column, rna: bool = False) -> Column:
    return F.reverse(complement(seq, rna))


def to_rna(seq: Column) -> Column:
    return F.translate(seq, "Tt", "Uu")


def to_dna(seq: Column) -> Column:
    return F.translate(seq, "Uu", "Tt")


def codon_table() -> dict[str, str]:
    bases = "TCAG"
    return {a + b + c: _AMINO[16 * i + 4 * j + k] for i, a in enumerate(bases) for j, b in enumerate(bases) for k, c in enumerate(bases)}


def translate_frame(seq: Column, frame: int = 0) -> Column:
    """Amino acids of a reading frame (0 to 2); unknown codons are '.', and trailing ones are stripped; a rest of one or two bases is left out."""
    table = F.create_map(*(F.lit(x) for kv in codon_table().items() for x in kv))
    n = F.floor((F.length(seq) - frame) / 3).cast("int")
    codons = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.coalesce(F.try_element_at(table, F.upper(F.substring(seq, i * 3 + frame + 1, F.lit(3)))), F.lit(".")))
    return F.regexp_replace(F.array_join(codons, ""), r"\.+$", "")


def frames(df: DataFrame, seq: str = "seq", strand: str = "strand") -> DataFrame:
    """df with (frame, protein): three frames of the sequence, six if unstranded (frames 3 to 5 are of the reverse complement)."""
    fwd = [F.struct(F.lit(k).alias("frame"), translate_frame(F.col(seq), k).alias("protein")) for k in range(3)]
    rev = [F.struct(F.lit(3 + k).alias("frame"), translate_frame(F.col("_rc"), k).alias("protein")) for k in range(3)]
    both = df.withColumn("_rc", reverse_complement(F.col(seq)))
    return both.withColumn("_f", F.explode(F.when(F.col(strand) == ".", F.array(*fwd, *rev)).otherwise(F.array(*fwd)))).select(*df.columns, "_f.frame", "_f.protein")


def open_frames(protein: Column) -> Column:
    """Array of reading frames from an M to a stop (kept) or the end."""
    return F.regexp_extract_all(protein, F.lit(r"M[^*]*\*?"), F.lit(0))


def first_orf(seq: Column) -> Column:
    """Bases of the frame from the first ATG to its stop (included) or the end; '' without an ATG."""
    at = F.instr(F.upper(seq), "ATG")
    protein = translate_frame(F.substring(seq, at, F.length(seq)), 0)
    stop = F.instr(protein, "*")
    n = F.when(stop > 0, stop * 3).otherwise(F.length(seq))
    return F.when(at > 0, F.substring(seq, at, n)).otherwise("")


def longer_orf(seq: Column, strand: Column) -> Column:
    """First ORF; for unstranded sequences the longer of both strands, ties to the given one."""
    plus, minus = first_orf(seq), first_orf(reverse_complement(seq))
    return F.when((strand == ".") & (F.length(minus) > F.length(plus)), minus).otherwise(plus)


def spliced(df: DataFrame, chroms: DataFrame) -> DataFrame:
    """(tid, seq): exon slices of the chromosome, joined, upper case, reverse complement on -; none of only N. df: tid, chrom, strand, exons; chroms: chrom, bases."""
    parts = F.transform("exons", lambda x: F.substring(F.col("bases"), x["s"].cast("int") + 1, (x["e"] - x["s"]).cast("int")))
    joined = F.upper(F.array_join(parts, ""))
    out = df.join(chroms, "chrom").select("tid", F.when(F.col("strand") == "-", reverse_complement(joined)).otherwise(joined).alias("seq"))
    return out.where("length(seq) > 0 AND NOT seq RLIKE '^N*$'")


def wrap(seq: Column, width: int = 60) -> Column:
    """Lines of at most width characters."""
    return F.rtrim(F.regexp_replace(seq, f"(.{{1,{width}}})", "$1\n"), F.lit("\n"))


def unique_orfs(orfs: DataFrame) -> DataFrame:
    """(orf_id, orf, orf_length, total_occurrences, unique_genomic_occurrences) of equal sequences, ids by sorted sequence. orfs: orf, chrom, strand, s, e."""
    from spanloom.operators.filters import global_rank

    places = orfs.groupBy("orf", "chrom", "strand", "s", "e").agg(F.count(F.lit(1)).alias("n"))
    one = places.groupBy("orf").agg(F.sum("n").alias("total_occurrences"), F.count(F.lit(1)).alias("unique_genomic_occurrences"))
    ranked = global_rank(one, ["orf"], "_no", start=0)
    return ranked.select(F.format_string("ORF%09d", "_no").alias("orf_id"), "orf", F.length("orf").alias("orf_length"), "total_occurrences", "unique_genomic_occurrences")
