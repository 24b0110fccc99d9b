"""Near-duplicates by shingle similarity, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from spanloom.llm import minhash, simhash
from tests.llm.test_ops import DOCS, brute_fingerprint, rows, union


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def similarity(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b)


def planted(seed=5):
    rng = random.Random(seed)
    data = [(9000, None), (9001, ""), (9002, "Two  words"), (9003, "two words")]
    for _ in range(60):
        words = rng.choices([f"w{k}" for k in range(500)], k=rng.choice([3, 5, 80, 300]))
        data.append((len(data), " ".join(words)))
        for _ in range(rng.randint(0, 3)):
            words = list(words)
            for _ in range(rng.randint(1, 6)):
                words[rng.randrange(len(words))] = f"changed{rng.randrange(9)}"
            data.append((len(data), "\t".join(words)))
    return data


def test_similar_documents_equal_brute_force(spark):
    data = planted()
    got = rows(simhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string").withColumn("node", F.lit(1)), shingle=5, least=0.8))
    ids = [i for i, _ in data]
    links = [(a, b) for a, x in data for b, y in data if a < b and similarity(x, y) >= 0.8]
    want = union(ids, links)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert len(set(want.values())) < len(want) - 20


def links_of(spark, texts, **options):
    by = {minhash.node(h): h for h in map(minhash.shingles, texts)}
    data = []
    for n, h in by.items():
        keys, sig = minhash.sketch(h)
        data.append((n, len(h), keys.tolist(), sig))
    sets = spark.createDataFrame(data, "node long, n long, keys array<long>, sig binary")
    bodies = spark.createDataFrame([(n, h.view("int64").tolist()) for n, h in by.items()], "node long, body array<long>")
    pairs = [(r["u"], r["v"]) for r in rows(minhash.similar_links(sets, lambda nodes: bodies.join(nodes, "node"), **options))]
    return by, pairs


@pytest.mark.parametrize("crowd", [2, 64])
def test_a_crowd_is_one_group(spark, crowd):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(400)]
    by, pairs = links_of(spark, [" ".join([*words, f"tail{i}", rng.choice(words)]) for i in range(60)], crowd=crowd)
    assert len(set(union(by, pairs).values())) == 1


@pytest.mark.parametrize(("block", "along"), [(8, 512), (512, 512), (8, 298), (512, 0)])
def test_a_crowd_of_many_groups(spark, block, along, monkeypatch):
    """Texts that share two thirds of their words meet under the same keys; pairs among them are found though no hub links them, whether
    sets come along or are looked up."""
    monkeypatch.setattr(minhash, "ALONG", along)
    rng = random.Random(6)
    base = [f"w{k}" for k in range(300)]
    texts = []
    for g in range(40):
        own = base[:200] + [f"g{g}x{k}" for k in range(100)]
        for _ in range(rng.choice([1, 2, 3])):
            copy = list(own)
            copy[rng.randrange(200, 300)] = f"c{rng.random()}"
            texts.append(" ".join(copy))
    by, pairs = links_of(spark, texts, crowd=2, block=block)
    each = list(by.items())
    want = [(a, b) for i, (a, x) in enumerate(each) for b, y in each[:i] if minhash.jaccard(x, y) >= 0.8]
    assert want and union(by, pairs) == union(by, want)
    if along:
        assert len(pairs) < 3 * len(each)


def test_pairs_of_long_sets_are_given_about_once(spark, monkeypatch):
    """Texts too long to come along are almost similar in pairs and share hundreds of rare shingles: a pair isn't given under each of them."""
    monkeypatch.setattr(minhash, "ALONG", 100)
    rng = random.Random(9)
    texts = []
    for g in range(12):
        own = [f"w{k}" for k in range(500)] + [f"g{g}x{k}" for k in range(300)]
        for _ in range(4):
            copy = list(own)
            for at in rng.sample(range(500, 800), 14):
                copy[at] = f"c{rng.random()}"
            texts.append(" ".join(copy))
    given, alike = [spark.sparkContext.accumulator(0) for _ in range(2)], minhash._alike

    def counted(batches, least):
        for out in alike(batches, least):
            given[0].add(len(out))
            given[1].add(int(out["sure"].sum()))
            yield out

    monkeypatch.setattr(minhash, "_alike", counted)
    by, pairs = links_of(spark, texts, crowd=2)
    each = list(by.items())
    want = [(a, b) for i, (a, x) in enumerate(each) for b, y in each[:i] if minhash.jaccard(x, y) >= 0.8]
    assert union(by, pairs) == union(by, want)
    assert 0 < given[0].value < 4 * len(each) and not given[1].value


def test_odd_identifiers(spark):
    twice = spark.createDataFrame([(1, "a b c d"), (1, "x y z"), (5, "x y z"), (None, "x y z")], "doc_id long, text string")
    assert [r["component_id"] for r in rows(simhash.near_duplicates(twice, shingle=5, least=0.8))] == [1] * 4
    assert simhash.near_duplicates(twice.limit(0), shingle=5, least=0.8).count() == 0


def test_stage_drops_copies_beyond_three_bits(spark, sf_dir):
    rng = random.Random(8)
    words = rng.choices([f"w{k}" for k in range(500)], k=200)
    text, copy = " ".join(words), " ".join([*words[:60], "one", *words[61:120], "two", *words[121:]])
    assert similarity(text, copy) >= 0.8
    assert (brute_fingerprint(text) ^ brute_fingerprint(copy)).bit_count() > 3
    docs = spark.createDataFrame([(1, text, "en", "a", 0), (2, copy, "en", "a", 0), (3, " ".join(rng.choices(words, k=200)), "en", "a", 0)], DOCS)
    assert sorted(r["doc_id"] for r in rows(cp.drop_near_copies(spark, docs, sf_dir))) == [1, 3]
