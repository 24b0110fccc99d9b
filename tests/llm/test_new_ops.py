"""Operators 11 to 13: against the tokenizer's library, brute force, and awkward tables."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from spanloom.llm import negatives, spelling, token_counts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=token_counts.MODEL)


@pytest.fixture(scope="module")
def merger():
    return token_counts.Merger(token_counts.read_pieces(token_counts.MODEL))


# Operator 11


def test_token_counts_equal_the_library(spark, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = entry.queries()["op11_token_counts"](spark, SF).collect()
    want = dict(zip(docs, map(len, library.encode(list(docs.values()))), strict=True))
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows} == {i: (len(t.encode()), want[i], want[i] > 4096) for i, t in docs.items()}


def test_token_counts_of_odd_texts(library, merger):
    """Pieces in any order, repeats, characters outside the vocabulary, control strings, runs of spaces."""
    rnd, pieces = random.Random(3), token_counts.read_pieces(token_counts.MODEL)
    odd = [" ", "   ", "▁", "a", "the", "mouth", "é", "☃", "\n", "\t", "\x00", "漢", "🙂", "</s>", "<0x0A>", "institution"]
    texts = ["", " ", *odd]
    for _ in range(700):
        texts.append("".join(rnd.choice(odd) for _ in range(rnd.randint(0, 30))))
        texts.append("".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 12))))
        texts.append((rnd.choice(pieces) + rnd.choice(pieces)) * rnd.randint(1, 20))
        texts.append("".join(rnd.choice("thesanior") for _ in range(rnd.randint(1, 200))))
    want = [len(x) for x in library.encode(texts)]
    assert list(merger.totals(texts)) == want
    assert [merger.total(t) if t else 0 for t in texts] == want


@pytest.mark.parametrize("text", ["a" * 300_000, "mouth" * 40_000, "x\n" * 200_000, "the cat " * 90_000])
def test_token_counts_of_long_texts(library, merger, text):
    assert merger.total(text) == len(library.encode(text))


def test_token_counts_of_awkward_tables(spark, library):
    rows = [(1, None, 7), (1, None, 7), (None, "ab ab", 8), (2, "", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = sorted((str(r["doc_id"]), r["n_tokens"]) for r in token_counts.token_counts(df).collect())
    assert got == [("1", 0), ("1", 0), ("2", 0), ("None", len(library.encode("ab ab")))]
    assert token_counts.token_counts(df.where("doc_id = 5")).collect() == []


# Operator 12


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_pairs(words):
    return {(a, b) if len(a) < len(b) or len(a) == len(b) and a.encode() < b.encode() else (b, a) for k, a in enumerate(words) for b in words[:k] if one_edit(a, b)}


@pytest.mark.parametrize("crowd", [1, 6, spelling.CROWD])
def test_near_words_equal_brute_force(spark, crowd):
    rnd = random.Random(crowd)
    words = {"", "a", "b", "ab", "ba", "aa", "aaa", "é", "éa", "aé", "aaaaaaa", "aaaaaaaa", "x" * 3000, "x" * 3001, "x" * 2999 + "y"}
    words |= {"".join(rnd.choice("aé") for _ in range(rnd.randint(1, 7))) for _ in range(120)}
    words |= {"common" + "".join(rnd.choice("abc") for _ in range(4)) for _ in range(60)}
    words = sorted(words)
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "word string")
    got = [tuple(r) for r in spelling.near_words(df, crowd).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(words)


def test_forms_and_roots(spark):
    rows = [("kitten", 1000), ("kittens", 100), ("mittens", 10), ("mitten", 99), ("bitten", 1), ("sitten", 1000), ("alone", 5), ("zitten", 2)]
    df = spark.createDataFrame(rows, "word string, n long")
    got = {r["word"]: (r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling.group_variants(df).collect()}
    n = dict(rows)
    for w in n:
        near = sorted((x for x in n if one_edit(x, w)), key=lambda x: (-n[x], x))
        form = near[0] if near and n[near[0]] >= 10 * n[w] else None
        assert got[w][:3] == (len(near), form, n[form] if form else None)
    assert got["mittens"] == (2, "kittens", 100, "kitten") and got["alone"] == (0, None, None, "alone")
    assert spelling.group_variants(df.where("n < 0")).collect() == []


def test_slips_and_vocabulary(spark):
    import re

    texts = [(i, f"Straße ÉTÉ kitten{'é' * (i % 3)} Kitten×÷ sevenletters {'long' * 200}") for i in range(90)] + [(None, "kittens kittens"), (3, None), (4, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] += 1
    got = {r["word"]: r["n"] for r in spelling.vocabulary(spelling.slips(spelling.runs(df))).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}


# Operator 13


def brute_negatives(rows):
    """rows: (id, label, v)."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for k, (i, label, v) in enumerate(rows):
        if i % 100:
            continue
        scored = sorted((-dot(v, w), j, other == label) for m, (j, other, w) in enumerate(rows) if m != k)
        for ps, p in [(-s, j) for s, j, same in scored if same][:5]:
            fits = [(-s, j) for s, j, same in scored if not same and 80 * ps <= -100 * s <= 100 * ps][:5]
            out += [(i, p, r, j, ps, s) for r, (s, j) in enumerate(fits, 1)]
    return Counter(out)


def made(n, labels, spread, seed, dims=6):
    rnd = random.Random(seed)
    middles = [[rnd.randint(-60, 60) for _ in range(dims)] for _ in range(5)]
    return [(i * 10 - 200, rnd.randrange(labels), [x + rnd.randint(-spread, spread) for x in rnd.choice(middles)]) for i in range(n)]


@pytest.mark.parametrize(("n", "labels", "spread"), [(400, 3, 4), (300, 40, 60), (40, 1, 9), (200, 2, 0)])
def test_negatives_equal_brute_force(spark, monkeypatch, n, labels, spread):
    """Small trees, blocks, groups and tiles; clusters, many labels, one label, equal vectors."""
    for name, value in (("LEAF", 8), ("BLOCK", 64), ("ANCHORS", 6), ("MEET", 2), ("TILE", 3)):
        monkeypatch.setattr(negatives, name, value)
    rows = made(n, labels, spread, n)
    df = spark.createDataFrame(rows, "id long, label long, v array<long>").repartition(3)
    got = Counter(map(tuple, negatives.hard_negatives(df, lambda i: i % 100 == 0).collect()))
    assert got == brute_negatives(rows)


def test_dual_tree_prunes_and_stays_whole():
    """Node pairs that are left out hold nothing that is looked for, and some are left out."""
    import numpy as np
    import pandas as pd

    rows = made(1500, 4, 3, 1)
    window = [{"no": 0, "low": negatives._LOW, "high": negatives._HIGH}]
    anchors = pd.DataFrame([(k, i, label, v, window) for k, (i, label, v) in enumerate(rows) if k % 10 == 0], columns=["row", "id", "label", "v", "windows"])
    block = pd.Series({"rows": list(range(len(rows))), "ids": [r[0] for r in rows], "labels": [r[1] for r in rows], "v": [r[2] for r in rows]})
    search, scored = negatives.Search(anchors, 6, True, 5), []
    inner = search._score
    search._score = lambda lo, hi, x, *rest: (scored.append((hi - lo) * len(x)), inner(lo, hi, x, *rest))
    search.scan(block, 6)
    assert sum(scored) < 0.8 * len(rows) * len(anchors)
    x = np.array([r[2] for r in rows])
    for row, _, _, score, _, _ in search.rows():
        mine = [k for k, r in enumerate(rows) if r[1] == rows[row][1] and k != row]
        assert score >= sorted((x[mine] @ x[row]).tolist())[-5]


def test_negatives_of_awkward_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.25]), (2, 2, [1.0, 0.0]), (3, 2, [0.9, 0.4, 0.1]), (4, 2, [nan, 1.0]), (5, 2, [inf, 1.0]), (6, 2, [None, 1.0]), (7, None, [1.0, 1.0]),
        (8, 2, None), (None, 2, [1.0, 0.2]), (2, 2, [1.0, 0.0]), (100, 5, []), (200, 2, [-1.0, -1.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("row", F.lit(1)).withColumn("cell", F.lit("x"))
    vectors = negatives.integer_vectors(df)
    kept = [(r["id"], r["label"], r["v"]) for r in vectors.collect()]
    assert sorted(i for i, _, _ in kept) == [0, 1, 2, 2, 3, 100, 200]
    got = Counter(map(tuple, negatives.hard_negatives(vectors, lambda i: i % 100 == 0).collect()))
    assert got == brute_negatives(kept)
    assert negatives.hard_negatives(vectors.where("id = 77"), lambda i: i % 100 == 0).collect() == []


def test_scores_beyond_doubles():
    import numpy as np

    a = np.array([[1 << 40, 1]], np.int64)
    assert negatives._scores(a, np.array([[1 << 20, 3]], np.int64)).tolist() == [[(1 << 60) + 3]]


def test_registered_negatives(spark):
    rows = defaultdict(list)
    for r in entry.queries()["op13_hard_negatives"](spark, SF).collect():
        rows[r["anchor_id"], r["positive_id"]].append(r["rank"])
    assert rows and all(sorted(x) == list(range(1, len(x) + 1)) for x in rows.values())
