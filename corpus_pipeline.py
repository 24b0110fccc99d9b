"""The corpus pipeline: language ID, exact dedup, near dedup, mixing, tokens. Each stage's result is written and read as the next one's input.

Stages keep or drop rows, not identifiers: where rows are compared, each is known by its place in the stage's input, so rows that share a
doc_id, or have none, are judged one by one. All columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.bpe import digests
from spanloom.llm.common import bits_for, fresh, identified, key_bits, may_hold, stage, table
from spanloom.llm.exact_dedup import exact_groups
from spanloom.llm.langid import fit, held_out, predict
from spanloom.llm.mixing import mix
from spanloom.llm.simhash import near_duplicates

#: Near-duplicates: words of a shingle, and least Jaccard similarity.
SHINGLE, SIMILARITY = 5, 0.8


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language. Null texts, and texts without a letter, have none and go; an empty table stays empty. Where no
    labelled row is there to learn from, no text has one."""
    model = fit(docs.where(~held_out()))
    lang, score = fresh(docs, "lang_pred"), fresh(docs, "score")
    guessed = predict(docs, model, lang_out=lang, score_out=score)
    return guessed.where(F.col(lang) != "und").select(*docs.columns)


def _one_of_each(docs: DataFrame, no: str, groups: DataFrame, kept: Column) -> DataFrame:
    """docs without its row identifiers; of the groups' rows (no, ...) those that are kept."""
    gone = groups.where(~kept).select(F.col("_id")[no].alias(no))
    gone = stage(gone, "gone")
    # Most texts needn't be shuffled: a filter of what goes tells them.
    bits = bits_for(gone.count())
    rows = docs.select(F.col(no).alias("_key"), F.struct("*").alias("_row"))
    doubt = may_hold(rows, F.col("_key"), key_bits(gone, no, bits), bits)
    sure = may_hold(rows, F.col("_key"), key_bits(gone, no, bits), bits, wanted=False)
    left = doubt.join(gone, F.col("_key") == F.col(no), "left_anti").unionByName(sure)
    return left.select("_row.*").drop(no)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text (null counts as empty): that with the largest doc_id, any identifier before none; of rows that share both,
    one stays. An empty table stays empty."""
    no = fresh(docs, "_no")
    docs = identified(docs, no)
    rows = docs.select(F.struct("doc_id", no).alias("_id"), "text")
    return _one_of_each(docs, no, exact_groups(rows, id_col="_id", keep="max"), F.col("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five-word shingles, Jaccard similarity 0.8): that with the smallest doc_id, any identifier
    before none, of rows that share it that whose text has the smallest hash. Null texts and texts without words are one group. An empty
    table stays empty."""
    no = fresh(docs, "_no")
    docs = identified(docs, no)
    rows = docs.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("tie"), no).alias("_id"), "text")
    groups = near_duplicates(rows, id_col="_id", shingle=SHINGLE, least=SIMILARITY)
    return _one_of_each(docs, no, groups, F.col("_id") == F.col("component_id"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes its words: taken / size, rounded to whole rows (0, 1 or 2). Null and wordless texts are taken 0
    times; a null source is a source of its own; rows that share a doc_id are mixed row by row. An empty table stays empty."""
    no, copy = fresh(docs, "_no"), fresh(docs, "_copy")
    docs = identified(docs, no)
    taken = mix(docs, keep=[no]).where("size > 0").select(no, F.round(F.col("taken") / F.col("size")).cast("int").alias(copy))
    met = docs.join(taken.where(F.col(copy) > 0), no)
    return met.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy)))).drop(no, copy)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text, a row per row; null counts as empty."""
    return digests(docs)


STAGES = [
    ("language id", keep_language),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("tokens", tokenize),
]
#: Language prediction, near-duplicates and BPE are beyond SQL: tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
