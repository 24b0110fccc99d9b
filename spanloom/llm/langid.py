"""Operator 2: language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum over all its
segmentations into pieces, by the forward algorithm; a text's is the product over its words. Piece probabilities are fitted by expectation
maximisation on labelled texts: expected piece counts come from forward and backward sums, are added up by Spark, and only the
(language, piece) totals, bounded by the vocabulary, reach the driver.

Words are lower-cased, split at white space, marked at their start, and cut every 32 code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.common import fresh, give_back, ship, stage, table

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
#: Expected number of labelled texts per language that the piece probabilities are fitted on; texts are picked by a hash of their id.
SAMPLE_DOCS = 400
#: A worker forgets its words when it knows so many, or when their scores take CACHED_BYTES; it scores texts together until they have BATCH words.
CACHED_WORDS, CACHED_BYTES = 300_000, 64 << 20
BATCH = 50_000
_CUT, _LONGEST = 32, 16
_MARK = "▁"
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Marked words, the longest cut: 'abc' -> '▁abc'."""
    words = text.lower().split()
    if any(len(w) > _CUT for w in words):
        return [(_MARK if not at else "") + w[at : at + _CUT] for w in words for at in range(0, len(w), _CUT)]
    return [_MARK + w for w in words]


@dataclass
class Pieces:
    """Piece numbers by string; the number after the last stands for any character that is no piece."""

    names: list[str]
    keys: np.ndarray = field(init=False)
    numbers: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        hashes = np.zeros(len(self.names), np.uint64)
        lengths = np.array([len(n) for n in self.names])
        for n in np.unique(lengths):
            where = np.flatnonzero(lengths == n)
            *_, last = self._hashes(codes("".join(self.names[i] for i in where)).reshape(len(where), n), n)
            hashes[where] = last[:, 0]
        order = np.argsort(hashes)
        self.keys, self.numbers = hashes[order], order.astype(np.int32)

    @classmethod
    def read(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
        return cls(sorted({p for p in plain if len(p) <= _LONGEST and p == p.lower()}))

    @staticmethod
    def _hashes(chars: np.ndarray, longest: int) -> Iterator[np.ndarray]:
        """For each run length up to longest: hash of each run in each row. A run's hash grows from that of the run one shorter."""
        h = np.zeros_like(chars)
        for n in range(min(longest, chars.shape[1])):
            h = (h[:, : chars.shape[1] - n] ^ chars[:, n:]) * _PRIME
            h ^= h >> np.uint64(29)
            yield h

    def grid(self, words: list[str]) -> list[np.ndarray]:
        """For words of one length: piece numbers of all runs, by run length; one past the last stands for an unknown character, -1 for any other
        run that is no piece."""
        chars = codes("".join(words)).reshape(len(words), -1)
        found = []
        for h in self._hashes(chars, _LONGEST):
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            found.append(np.where(self.keys[at] == h, self.numbers[at], -1 if found else len(self.names)))
        return found


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def forward(found: list[np.ndarray], probs: np.ndarray) -> np.ndarray:
    """sums[j]: (words, languages), over all segmentations of the first j characters. probs: (pieces + 2, languages), the last row zero."""
    n, length = found[0].shape
    sums = np.zeros((length + 1, n, probs.shape[1]))
    sums[0] = 1
    for j in range(1, length + 1):
        for k in range(1, min(len(found), j) + 1):
            sums[j] += sums[j - k] * probs[found[k - 1][:, j - k]]
    return sums


def expected(found: list[np.ndarray], probs: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Expected uses of each piece under one language (probs: (pieces + 2, 1)), for words that occur so many times."""
    n, length = found[0].shape
    ahead = forward(found, probs)[:, :, 0]
    after = np.zeros((length + 1, n))
    after[length] = 1
    for i in range(length - 1, -1, -1):
        for k in range(1, min(len(found), length - i) + 1):
            after[i] += after[i + k] * probs[found[k - 1][:, i], 0]
    uses = np.zeros(len(probs))
    for k, ids in enumerate(found, 1):
        for i in range(length - k + 1):
            np.add.at(uses, ids[:, i], times * ahead[i] * probs[ids[:, i], 0] * after[i + k] / ahead[length])
    return uses


def by_length(words: list[str]) -> Iterator[np.ndarray]:
    """Places of words of equal lengths, so many at a time that their arrays stay in the processor's cache."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    ends = np.searchsorted(lengths[order], np.unique(lengths), side="right")
    for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
        for at in range(lo, hi, 4096):
            yield order[at : min(at + 4096, hi)]


@dataclass
class Model:
    pieces: Pieces
    languages: list[str]
    probs: np.ndarray  # (pieces + 2, languages)

    def __post_init__(self) -> None:
        self.known: dict[str, int] = {}
        self.most = max(1, min(CACHED_WORDS, CACHED_BYTES // (8 * max(1, len(self.languages)))))
        self.table = np.zeros((self.most, len(self.languages)))

    def log_words(self, words: list[str]) -> np.ndarray:
        """(words, languages): log probability of each."""
        out = np.zeros((len(words), len(self.languages)))
        for where in by_length(words):
            out[where] = np.log(np.maximum(forward(self.pieces.grid([words[i] for i in where]), self.probs)[-1], 1e-300))
        return out

    def score(self, texts: list[list[str]]) -> np.ndarray:
        """(texts, languages): log probability of each list of words. Words of many texts at a time keep the arrays long."""
        out = np.zeros((len(texts), len(self.languages)))
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        flat = [w for t in texts for w in t]
        step = min(2 * BATCH, self.most)
        for at in range(0, len(flat), step):
            part = flat[at : at + step]
            new = list({w for w in part if w not in self.known})
            if len(self.known) + len(new) > self.most:
                self.known.clear()
                new = list(set(part))
            if new:
                self.table[len(self.known) : len(self.known) + len(new)] = self.log_words(new)
                self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            rows = self.table[np.fromiter(map(self.known.__getitem__, part), np.int64, len(part))]
            starts = np.flatnonzero(np.r_[True, np.diff(owner[at : at + len(part)]) > 0])
            out[owner[at : at + len(part)][starts]] += np.add.reduceat(rows, starts, axis=0)
        return out


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocabulary: str = VOCABULARY, sample_docs: int = SAMPLE_DOCS, rounds: int = 2) -> Model:
    """Piece probabilities per language from rows with a label and a text."""
    spark = labelled.sparkSession
    ship(spark)
    pieces = Pieces.read(vocabulary)
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    languages = sorted(sizes)
    if not languages:
        return Model(pieces, [], np.zeros((len(pieces.names) + 2, 0)))
    part = F.element_at(F.create_map(*(F.lit(x) for lang in languages for x in (lang, min(1.0, sample_docs / sizes[lang])))), F.col("lang"))
    picked = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < part * (1 << 20))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(texts: pd.Series) -> pd.Series:
        return pd.Series([words_of(t) for t in texts], dtype=object)

    words = stage(picked.select("lang", F.explode(split("text")).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "language-words")
    v = len(pieces.names)
    probs = np.full((v + 2, len(languages)), 1 / (v + 1))
    probs[v + 1] = 0
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((pieces, languages, probs))  # vocabulary times languages
        counts = words.mapInPandas(lambda batches, sent=sent: _expect(batches, *sent.value), "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        probs = np.full_like(probs, 0.05)
        for r in counts.collect():  # at most vocabulary times languages
            probs[r["piece"], languages.index(r["lang"])] += r["n"]
        probs[v + 1] = 0
        probs /= probs.sum(axis=0)
    return Model(pieces, languages, probs)


def _expect(batches: Iterator[pd.DataFrame], pieces: Pieces, languages: list[str], probs: np.ndarray) -> Iterator[pd.DataFrame]:
    uses = np.zeros_like(probs)
    for batch in batches:
        for lang, rows in batch.groupby("lang"):
            k, words, times = languages.index(lang), rows["word"].tolist(), rows["n"].to_numpy(float)
            for where in by_length(words):
                uses[:, k] += expected(pieces.grid([words[i] for i in where]), probs[:, k : k + 1], times[where])
    piece, k = np.nonzero(uses[:-1] > 1e-6)
    if len(k):
        yield pd.DataFrame({"lang": [languages[i] for i in k], "piece": piece.astype(np.int32), "n": uses[piece, k]})


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """docs with lang_out and score_out (the posterior of the predicted language under equal priors, 0 to 1) added; columns of these names are replaced.

    A null text, or one without a letter, is ``und`` with score 0, as is any text when no language was learned; ties go to the first
    language by name. No shuffle; repeated rows get equal predictions; only the text is an input.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.pieces, model.languages, model.probs))

    @F.pandas_udf("lang string, score double")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from give_back(guesses(batches))

    def guesses(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Model(*sent.value)
        for texts in batches:
            langs, scores = ["und"] * len(texts), np.zeros(len(texts))
            open_rows: list[int] = []
            words: list[list[str]] = []
            size = 0
            for i, text in enumerate(texts):
                if text is not None and model.languages and any(map(str.isalpha, text)):
                    open_rows.append(i)
                    words.append(words_of(text))
                    size += len(words[-1])
                if size >= BATCH or (open_rows and i == len(texts) - 1):
                    logs = model.score(words)
                    odds = np.exp(logs - logs.max(axis=1, keepdims=True))
                    best = odds.argmax(axis=1)
                    scores[open_rows] = odds.max(axis=1) / odds.sum(axis=1)
                    for row, k in zip(open_rows, best, strict=True):
                        langs[row] = model.languages[k]
                    open_rows, words, size = [], [], 0
            yield pd.DataFrame({"lang": langs, "score": scores})

    both = fresh(docs, "_guess")
    return docs.withColumn(both, guess(F.col(text_col))).withColumns({lang_out: F.col(both)["lang"], score_out: F.col(both)["score"]}).drop(both)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
