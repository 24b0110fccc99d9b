"""Operator 9: BPE encoding by per-prefix dynamic programming, and decoding.

A BPE encoding of a word has exactly one last token at each prefix. It is the token that ends there (an Aho-Corasick automaton, which links
suffixes, lists all that do) and that is compatible with the last token of the prefix before it: merging their symbols gives just the two.
The last tokens are stored for all prefixes and followed back from the end. No merge queue, linear in the word's length.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import give_back, ship, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: A worker forgets its words, or its pairs, when it knows so many.
CACHED = 100_000
#: Words that are encoded, hashed and decoded at a time, so that a long text's ids never stand in memory as a whole.
CHUNK = 4096
_END = 256  # added to the code of a word's last byte


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: bytes that print as Latin-1 stand for themselves, others follow 255."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Encoder:
    """spec: the parsed tokenizer file of a word-end BPE (byte level, NFC, lower case, white space dropped)."""

    def __init__(self, spec: dict):
        model = spec["model"]
        suffix, vocab = model["end_of_word_suffix"], model["vocab"]
        self.names = {i: n for n, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.word = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        # Symbols: one character per byte, the last byte of a word shifted by _END.
        symbols: dict[int, str] = {}
        for byte, letter in enumerate(byte_letters()):
            symbols[vocab[letter]], symbols[vocab[letter + suffix]] = chr(byte), chr(byte + _END)
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            a, b, new = vocab[a], vocab[b], vocab[a + b]
            symbols[new] = symbols[a] + symbols[b]
            self.parts[new], self.rank[new], self.merged[a, b] = (a, b), rank, rank
        self.ends = ahocorasick.Automaton()
        for i, s in symbols.items():
            self.ends.add_word(s, (i, len(s)))
        self.ends.make_automaton()
        self.name_list = np.array([self.names.get(i) for i in range(max(self.names) + 1)], dtype=object)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, bytes] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether the symbols of two tokens, merged together, give these two tokens.

        The symbols at the seam are undone from the last merge to the first. While a pair stands there it may not merge: its rank must
        not come before the merge that next takes its left symbol away, nor at or before the one that takes its right symbol away
        (of equal merges the leftmost goes first).
        """
        key = (left, right)
        if key not in self.pairs:
            if len(self.pairs) >= CACHED:
                self.pairs.clear()
            self.pairs[key] = self._stays_apart(left, right)
        return self.pairs[key]

    def _stays_apart(self, left: int, right: int) -> bool:
        last = len(self.merged)
        left_gone, right_gone = last, last - 1  # ranks of the merges that consume the seam's symbols
        while True:
            rank = self.merged.get((left, right))
            if rank is not None and rank < left_gone and rank <= right_gone:
                return False
            made_left, made_right = self.rank.get(left, -1), self.rank.get(right, -1)
            if made_left < 0 and made_right < 0:
                return True
            # Of the two, the one made later is undone first; of equal merges the right one was made later.
            if made_left > made_right:
                left, left_gone = self.parts[left][1], made_left
            else:
                right, right_gone = self.parts[right][0], made_right

    def encode_word(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass").decode("latin-1")
        text = raw[:-1] + chr(ord(raw[-1]) + _END)
        last = [0] * (len(text) + 1)
        done = 0
        for at, (token, length) in self.ends.iter(text):
            end = at + 1
            if done == end:
                continue
            start = end - length
            if not start or self.compatible(last[start], token):
                last[end], done = token, end
        ids, at = [], len(text)
        while at:
            ids.append(last[at])
            at -= self.length(last[at])
        return ids[::-1]

    @lru_cache(maxsize=None)  # noqa: B019  one entry per vocabulary item
    def length(self, token: int) -> int:
        return sum(map(self.length, self.parts[token])) if token in self.parts else 1

    def pieces(self, text: str) -> Iterator[bytes]:
        """The ids of each word and special token, as little-endian unsigned 32-bit integers."""
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                yield struct.pack("<I", self.added[part])
                continue
            part = unicodedata.normalize("NFC", part)
            part = part.lower() if "Σ" not in part else "".join(map(str.lower, part))  # by character: no final-sigma rule
            for word in self.word.findall(part):
                if (known := self.words.get(word)) is None:
                    if len(self.words) >= CACHED:
                        self.words.clear()
                    ids = self.encode_word(word)
                    known = struct.pack(f"<{len(ids)}I", *ids)
                    if len(word) < 64:
                        self.words[word] = known
                yield known

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(self.pieces(text)), "<u4").tolist()

    def decode(self, ids: Sequence[int]) -> str:
        """Token names joined by spaces, as the file names no decoder; unknown ids are skipped."""
        ids = np.asarray(ids, np.int64)
        names = self.name_list[ids[(ids >= 0) & (ids < len(self.name_list))]]
        return " ".join([n for n in names.tolist() if n is not None])


_encoders: dict[str, Encoder] = {}


def encoder(spec: str) -> Encoder:
    """One per worker and file, whose contents are given."""
    if spec not in _encoders:
        _encoders.clear()
        _encoders[spec] = Encoder(json.loads(spec))
    return _encoders[spec]


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:  # on the driver; its contents (2 MB) go to the executors
        return f.read()


def encode(docs: DataFrame, text_col: str = "text", out: str = "ids", tokenizer: str = TOKENIZER) -> DataFrame:
    """docs with the array of token ids of a text added. Null counts as empty; an empty text has no ids."""
    ship(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(_read(tokenizer))

    @F.pandas_udf("array<int>")
    def to_ids(texts: pd.Series) -> pd.Series:
        enc = encoder(spec.value)
        return texts.map(lambda t: enc.encode(t or ""))

    return docs.withColumn(out, to_ids(F.col(text_col)))


def decode(docs: DataFrame, ids_col: str = "ids", out: str = "decoded", tokenizer: str = TOKENIZER) -> DataFrame:
    """docs with the decoded text of an array of ids added; null counts as no ids, unknown ids are skipped."""
    ship(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(_read(tokenizer))

    @F.pandas_udf("string")
    def to_text(ids: pd.Series) -> pd.Series:
        enc = encoder(spec.value)
        return ids.map(lambda x: enc.decode(x if x is not None else []))

    return docs.withColumn(out, to_text(F.col(ids_col)))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """id_col, n_tokens, ids_sha256 and decoded_sha256 of each row's encoding and of what its ids decode to; ids never leave the worker. Null
    counts as empty; an empty table gives an empty result; repeated rows give equal rows."""
    spec = docs.sparkSession.sparkContext.broadcast(_read(tokenizer))

    ship(docs.sparkSession)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from give_back(map(digests_of, batches))

    def digests_of(texts: pd.Series) -> pd.DataFrame:
        enc, rows = encoder(spec.value), []
        for text in texts:
            of_ids, of_text, n = hashlib.sha256(), hashlib.sha256(), 0
            pieces = enc.pieces(text or "")
            while chunk := list(islice(pieces, CHUNK)):
                raw = b"".join(chunk)
                ids = np.frombuffer(raw, "<u4")
                of_ids.update(raw)
                of_text.update((" " if n else "").encode() + enc.decode(ids).encode())
                n += len(ids)
            rows.append((n, of_ids.hexdigest(), of_text.hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col), digest(F.col(text_col)).alias("_d")).select(id_col, "_d.*")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
