"""Operator 7: quality rules with cross-document line frequency.

Lines are normalised (lower case, single spaces) and hashed; for each host (here: source) the distinct documents of every line are counted.
Lines in more documents than the host's limit are boilerplate and are removed; a document that loses too much is depleted and rejected. Base
rules on words and repetition come first.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import ship, stage, table
from spanloom.operators.joins import lookup_join

_SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\x0b\x0c\r"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A line is boilerplate in more than MAX_DOCS documents of its host, in a small host in more than this share of them, but never in MIN_DOCS
#: or fewer.
MAX_DOCS, MAX_SHARE, MIN_DOCS = 30, 0.2, 3
#: So many (host, line) pairs are broadcast (30 bytes each).
FEW_LINES = 200_000
#: A document is depleted with fewer words left, or a smaller part of its words.
LEAST_LEFT, LEAST_PART = 20, 0.5


def repeated_words(words: list[str], window: int = 8) -> int:
    """Words inside windows (window: a power of two) that occur at least twice in the list, the first occurrence included."""
    if len(words) < window:
        return 0
    numbers: dict[str, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    width = 1
    while width < window:  # numbers of windows of twice the width
        pairs = ids[: len(ids) - width] * (int(ids.max()) + 1) + ids[width:]
        _, ids, times = np.unique(pairs, return_inverse=True, return_counts=True)
        width *= 2
    starts = np.flatnonzero(times[ids] > 1)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def words_hash(words: list[str]) -> int:
    """Signed hash of a line's words in lower case."""
    h = xxhash.xxh64_intdigest(" ".join(words).lower().encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def line_hash(line: str) -> int:
    """Signed hash of a normalised line."""
    return words_hash(_WORD.findall(line))


def measure(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and a (hash, words in all its copies) for each distinct line with a word."""
    text = text or ""
    words: list[str] = []
    known: dict[str, int] = {}
    lines: dict[int, int] = {}
    dup = 0
    for line in text.split("\n"):
        own = _WORD.findall(line)
        if own:
            words += own
            if (h := known.get(line)) is None:
                h = known[line] = words_hash(own)
            else:
                dup += 1
            lines[h] = lines.get(h, 0) + len(own)
    chars = len(text) - sum(map(text.count, _SPACE))
    return len(words), chars, sum(map(text.count, _SYMBOLS)), dup, repeated_words(words), [{"h": h, "w": n} for h, n in lines.items()]


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(id, host, the numbers of measure, lines); null hosts are one host of their own."""
    ship(docs.sparkSession)

    @F.pandas_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<h:long,w:long>>")
    def numbers(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t) for t in texts], columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"])

    host = F.coalesce(F.concat(F.lit("="), F.col(host_col)), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), host.alias("host"), numbers(F.col(text_col)).alias("m")).select("id", "host", "m.*")


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per row of docs: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words, removed
    (hashes of its boilerplate lines), kept.

    A null or empty text has no words and fails the base rules; so does any text under 20 words, or with over 30 in 100 of its words in
    repeated 8-word windows. Each row is a document: repeated rows count as many documents. An empty table gives an empty result; other
    columns are ignored. Only line hashes are shuffled; a line in a third of all documents is counted within each task first, and looked
    up without a shuffle.
    """
    marked = stage(measures(docs, id_col, text_col, host_col), "line-hashes")
    most = F.least(F.lit(float(max_docs)), F.greatest(F.lit(float(min_docs)), F.count(F.lit(1)) * F.lit(max_share)))
    limits = marked.groupBy("host").agg(most.alias("most"))
    counts = marked.select("host", F.explode("lines.h").alias("h")).groupBy("host", "h").agg(F.count(F.lit(1)).alias("n"))
    common = counts.where(F.col("n") > min_docs).join(limits, "host").where("n > most")
    common = stage(common.select(F.struct("host", "h").alias("line_key"), "n", F.lit(True).alias("common")), "common-lines")
    fields = [c for c in marked.columns if c != "lines"]
    lines = marked.withColumn("row", F.monotonically_increasing_id()).select("row", *fields, F.explode_outer("lines").alias("line"))
    lines = lines.select("row", *fields, "line.h", "line.w", F.struct("host", "line.h").alias("line_key"))
    if common.count() <= FEW_LINES:
        met = lines.join(F.broadcast(common.drop("n")), "line_key", "left")
    else:
        met = lookup_join(lines, common, "line_key", "n")
    gone = F.when(F.col("common"), F.col("w")).otherwise(0)
    judged = met.groupBy("row", *fields).agg(F.sum(gone).alias("removed_words"), F.collect_list(F.when(F.col("common"), F.col("h"))).alias("removed"))
    left = F.col("n_words") - F.col("removed_words")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    kept = ~failed & (left >= LEAST_LEFT) & (left >= LEAST_PART * F.col("n_words"))
    return judged.withColumn("base_failed", failed).withColumn("kept", kept).withColumnRenamed("id", id_col).select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "removed", "kept")


def remove_lines(docs: DataFrame, text_col: str = "text", removed_col: str = "removed") -> DataFrame:
    """docs with the lines whose hashes removed_col holds taken out of the text; a null text stays null."""

    @F.pandas_udf("string")
    def without(texts: pd.Series, removed: pd.Series) -> pd.Series:
        out: list[str | None] = []
        for text, gone in zip(texts, removed, strict=True):
            drop = set() if gone is None else set(gone)
            out.append(text if text is None or not drop else "\n".join(x for x in text.split("\n") if not _WORD.search(x) or line_hash(x) not in drop))
        return pd.Series(out, dtype=object)

    return docs.withColumn(text_col, without(F.col(text_col), F.col(removed_col)))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents")).drop("removed")


_SQL_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
OP7_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, {_SQL_WORDS.format("t")} AS w FROM d),
b AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM w),
l AS (SELECT doc_id, source, l, {_SQL_WORDS.format("l")} AS w FROM (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS l FROM d) AS x),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM l WHERE len(w) > 0 GROUP BY doc_id),
k AS (SELECT doc_id, source, lower(array_to_string(w, ' ')) AS k, sum(len(w)) AS n FROM l WHERE len(w) > 0 GROUP BY ALL),
m AS (SELECT source AS m_source, least({MAX_DOCS}.0, greatest({MIN_DOCS}.0, count(*) * {MAX_SHARE})) AS most FROM d GROUP BY source),
c AS (SELECT source AS c_source, k AS c_k FROM k JOIN m ON source IS NOT DISTINCT FROM m_source GROUP BY source, k, most HAVING count(*) > most),
gone AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n FROM k JOIN c ON k = c_k AND source IS NOT DISTINCT FROM c_source GROUP BY doc_id),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w) AS x),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) AS x WHERE n > 1),
p AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS i FROM r) AS x GROUP BY doc_id),
j AS (SELECT b.*, coalesce(dup.n, 0) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS removed_words
  FROM b LEFT JOIN dup USING (doc_id) LEFT JOIN p USING (doc_id) LEFT JOIN gone USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM j)
SELECT *, NOT base_failed AND n_words - removed_words >= {LEAST_LEFT} AND n_words - removed_words >= {LEAST_PART} * n_words AS kept FROM f
"""
