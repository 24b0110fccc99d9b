"""Operator 11: token counts by rank-synchronous merging.

A text is cut into pre-tokens where no piece of the vocabulary can reach across. The pre-tokens of a batch lie one after the other in one
numpy array of symbols (a ragged array); in each round every sequence applies its lowest-rank pair, wherever it stands, all sequences at
once. Sequences without a pair leave the array, and what is left of them is counted.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import ship, table

MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: The default limit of over_limit.
LIMIT = 4096
#: Pre-tokens of the cache, which is emptied when full; longer ones than LONG characters aren't kept.
CACHED, LONG = 200_000, 64
#: Characters, and pre-tokens, that are merged at a time (one longer pre-token is merged whole).
BATCH_CHARS, BATCH_WORDS = 1 << 19, 1 << 16
SPACE = "▁"
#: A pre-token: a run of spaces with what follows, or a start without a space.
PRETOKEN = re.compile(f"[ {SPACE}]+[^ {SPACE}]*|[^ {SPACE}]+")
_NONE = np.int32(1 << 30)


def read_pieces(path: str) -> list[str]:
    """The pieces of a BPE model with byte fallback in merge order: the best score first."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    if any(model.is_unused(i) for i in plain):
        raise ValueError("models with unused pieces are not supported")
    return [model.id_to_piece(i) for i in sorted(plain, key=lambda i: -model.get_score(i))]


class Merger:
    """Merge tables of a vocabulary. A symbol is the rank of its piece; characters outside the vocabulary are symbols of their own, one for
    each number of bytes that they fall back to."""

    def __init__(self, pieces: list[str]):
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("pieces that go on over a space are not supported")
        rank = {p: i for i, p in enumerate(pieces)}
        self.size = len(pieces) + 5
        self.weight = np.ones(self.size, np.int64)
        self.weight[len(pieces) + 1 :] = np.arange(1, 5)
        points = np.arange(0x110000)
        self.symbol = (len(pieces) + 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)).astype(np.int32)
        pairs, inner, beaten = {}, set(), set()
        for piece, i in rank.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        self.symbol[ord(" ")] = self.symbol[ord(SPACE)]
        for piece, i in rank.items():
            inner.update(zip(piece, piece[1:], strict=False))
            for at in range(1, len(piece)):
                left, right = rank.get(piece[:at]), rank.get(piece[at:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = i
                    beaten.update(x for x in (left, right) if x > i)
        # Characters that stand side by side in a piece are in the table too, so that all other places are known to be cuts.
        for a, b in inner:
            pairs.setdefault(int(self.symbol[ord(a)]) * self.size + int(self.symbol[ord(b)]), int(_NONE))
        self._place(np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32))
        #: Symbols that, once made, can be part of a pair that comes before them.
        self.beaten = np.zeros(self.size, bool)
        self.beaten[list(beaten)] = True
        self.known: dict[str, int] = {}

    def _place(self, keys: np.ndarray, made: np.ndarray) -> None:
        """The hash table of pairs: arrays of keys and what they merge to, a key in the first free slot from its own on."""
        bits = max(10, int(8 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.made = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE)
        slot = self._slot(keys)
        while len(keys):
            _, first = np.unique(slot, return_index=True)
            first = first[self.keys[slot[first]] < 0]
            self.keys[slot[first]], self.made[slot[first]] = keys[first], made[first]
            rest = self.keys[slot] != keys
            keys, made, slot = keys[rest], made[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each pair merges to (_NONE without a merge), and whether it is in the table."""
        keys = left.astype(np.int64) * self.size + right
        slot = self._slot(keys)
        seen = self.keys[slot]
        open_ = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            seen[open_] = self.keys[slot[open_]]
            open_ = open_[(seen[open_] != keys[open_]) & (seen[open_] >= 0)]
        held = seen == keys
        return np.where(held, self.made[slot], _NONE), held

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self._find(left, right)[0]

    def counts(self, words: list[str]) -> np.ndarray:
        """The number of tokens of each word (none is empty)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        sym, word = self.symbol[points], np.repeat(np.arange(len(words)), lengths)
        # A sequence begins with a word, and where no piece holds the two characters side by side.
        made, side = self._find(sym[:-1], sym[1:])
        fresh = np.concatenate([[True], (word[1:] != word[:-1]) | ~side])
        pair = np.append(np.where(fresh[1:], _NONE, made), _NONE)
        total = np.zeros(len(words), np.int64)
        while len(sym):
            starts = np.flatnonzero(fresh)
            seq = np.cumsum(fresh) - 1
            least = np.minimum.reduceat(pair, starts)
            over = least == _NONE
            if over.any():
                gone = over[seq]
                np.add.at(total, word[gone], self.weight[sym[gone]])
                live = ~gone
                sym, word, fresh, pair = sym[live], word[live], fresh[live], pair[live]
                if not len(sym):
                    break
                starts, least = np.flatnonzero(fresh), least[~over]
                seq = np.cumsum(fresh) - 1
            sym, word, fresh, pair = self._round(sym, word, fresh, pair, starts, seq, least)
        return total

    def _round(self, sym, word, fresh, pair, starts, seq, least):
        """The arrays after each sequence has merged its least pair."""
        here = np.arange(len(sym))
        hit = pair == least[seq]
        # Of overlapping hits the leftmost goes first, so every second one of a run of hits.
        run = here - np.maximum.accumulate(np.where(hit, -1, here)) - 1
        pick = hit & (run % 2 == 0)
        risky = np.flatnonzero(pick & self.beaten[least[seq]])
        if len(risky):
            # One by one, from the left, a new symbol could at once be part of a pair that comes before the remaining ones. Where that is so, only
            # the leftmost pair of the sequence is merged in this round.
            new, mine = least[seq[risky]], seq[risky]
            ahead, behind = np.minimum(risky + 2, len(sym) - 1), np.maximum(risky - 1, 0)
            after = (risky + 2 < len(sym)) & (seq[ahead] == mine)
            before = (risky > 0) & (seq[behind] == mine)
            left = np.where((risky > 1) & pick[np.maximum(risky - 2, 0)] & (seq[np.maximum(risky - 2, 0)] == mine), new, sym[behind])
            early = (after & (self.merged(new, sym[ahead]) < new)) | (before & (self.merged(left, new) < new))
            if early.any():
                careful = np.zeros(len(starts), bool)
                careful[mine[early]] = True
                at = np.flatnonzero(pick)
                first = np.zeros(len(sym), bool)
                first[at[np.concatenate([[True], seq[at[1:]] != seq[at[:-1]]])]] = True
                pick &= first | ~careful[seq]
        at = np.flatnonzero(pick)
        sym = sym.copy()
        sym[at] = least[seq[at]]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        changed = pick[keep]
        sym, word, fresh, pair = sym[keep], word[keep], fresh[keep], pair[keep]
        last = np.concatenate([fresh[1:], [True]])
        redo = np.flatnonzero((changed | np.concatenate([changed[1:], [False]])) & ~last)
        pair[changed & last] = _NONE
        pair[redo] = self.merged(sym[redo], sym[redo + 1])
        return sym, word, fresh, pair

    def learn(self, words: Iterable[str]) -> dict[str, int]:
        """Counts of distinct words, in batches."""
        found: dict[str, int] = {}
        batch, chars = [], 0
        for w in words:
            batch.append(w)
            chars += len(w)
            if chars >= BATCH_CHARS:
                found.update(zip(batch, self.counts(batch).tolist(), strict=True))
                batch, chars = [], 0
        if batch:
            found.update(zip(batch, self.counts(batch).tolist(), strict=True))
        return found

    def totals(self, texts: Iterable[str]) -> Iterator[int]:
        """The number of tokens of each text, for texts that are small together."""
        cut = [PRETOKEN.findall(" " + t) if t else [] for t in texts]
        known = self.known
        new = set().union(*cut).difference(known)
        if len(known) + len(new) > CACHED:
            known.clear()
            new = set().union(*cut)
        found = self.learn(new)
        known.update((w, n) for w, n in found.items() if len(w) <= LONG)
        count = {**known, **found}.__getitem__ if any(len(w) > LONG for w in found) else known.__getitem__
        for words in cut:
            yield sum(map(count, words))

    def total(self, text: str) -> int:
        """The number of tokens of one text, cut and counted piecemeal, so that a long text's pre-tokens never stand in memory together."""
        words, n = (m.group() for m in PRETOKEN.finditer(" " + text)), 0
        while some := list(islice(words, BATCH_WORDS)):
            found = self.learn(set(some))
            n += sum(map(found.__getitem__, some))
        return n


_mergers: dict[int, Merger] = {}


def merger(pieces: list[str]) -> Merger:
    """One per worker and vocabulary."""
    key = hash(tuple(pieces))
    if key not in _mergers:
        _mergers.clear()
        _mergers[key] = Merger(pieces)
    return _mergers[key]


def token_counts(docs: DataFrame, text_col: str = "text", out: str = "n_tokens", model: str = MODEL) -> DataFrame:
    """docs with the number of tokens of its texts added (long): as the model's library encodes them, without added tokens; strings of control
    tokens inside texts are plain text. Null counts as empty, and an empty text has no tokens; equal rows get equal counts; an empty table
    stays empty. A column of the name ``out`` is replaced. A worker holds one batch of texts, and one text's distinct pre-tokens in parts.
    """
    ship(docs.sparkSession)
    pieces = docs.sparkSession.sparkContext.broadcast(read_pieces(model))

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = merger(pieces.value)
        for texts in batches:
            result, some, chars = [], [], 0
            for text in texts:
                text = text or ""
                if len(text) >= BATCH_CHARS:
                    result += known.totals(some)
                    result.append(known.total(text))
                    some, chars = [], 0
                    continue
                some.append(text)
                chars += len(text)
                if chars >= BATCH_CHARS:
                    result += known.totals(some)
                    some, chars = [], 0
            result += known.totals(some)
            yield pd.Series(result, dtype="int64")

    return docs.withColumn(out, count(F.col(text_col)))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return token_counts(docs).select("doc_id", size.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
