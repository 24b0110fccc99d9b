"""The pipeline against a brute-force version, and edge cases that every stage must survive."""

import hashlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline as cp
from spanloom.llm import bpe, langid, mixing
from tests.llm.test_minhash import grams
from tests.llm.test_ops import DOCS, union


def staged(spark, docs, sf_dir):
    """The input and each stage's rows."""
    out = [docs]
    for _, f in cp.STAGES:
        out.append(cp.stage(f(spark, out[-1], sf_dir), "test"))
    return out


def brute_kept(docs, spoken):
    """Rows (doc_id, text, ...) that reach the mixing stage, one by one. spoken: texts that have a language."""
    by_text = {}
    for r in docs:
        if r[1] in spoken and (r[1] not in by_text or (r[0] is not None, r[0] or 0) > (by_text[r[1]][0] is not None, by_text[r[1]][0] or 0)):
            by_text[r[1]] = r
    tie = lambda text: xxhash.xxh64_intdigest(text.encode(), 42) + (1 << 63) & (1 << 64) - 1  # noqa: E731  signed order
    left = sorted(by_text.values(), key=lambda r: (r[0] is None, r[0] or 0, tie(r[1])))
    sets = [grams(r[1]) for r in left]
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b) - 1e-9
    pairs = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and alike(a, b)]
    group = union(range(len(left)), pairs)
    return [r for i, r in enumerate(left) if group[i] == i]


def test_pipeline_equals_brute_force(spark, sf_dir):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    data = [(r["doc_id"], r["text"]) for r in docs.collect()]
    text = dict(data)
    kept = {r[0] for r in brute_kept(data, {x for _, x in data if any(map(str.isalpha, x or ""))})}
    stages = staged(spark, docs, sf_dir)
    assert {r["doc_id"] for r in stages[3].collect()} == kept and len(kept) < len({x for _, x in data})
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix(docs.where(F.col("doc_id").isin(sorted(kept)))).collect()}
    times = Counter({i: int(t / s + 0.5) for i, (t, s) in taken.items() if s and int(t / s + 0.5)})
    assert Counter(r["doc_id"] for r in stages[4].collect()) == times
    lib = Tokenizer.from_file(bpe.TOKENIZER)
    want = Counter()
    for i, n in times.items():
        ids = lib.encode(text[i], add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()] += n
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in stages[5].collect()) == want
    assert all(s.columns == docs.columns for s in stages[:5])


def test_rows_with_shared_and_missing_identifiers(spark, sf_dir):
    """Whole rows, as multisets: repeated rows, one doc_id with several texts, texts without a doc_id, near copies among them."""
    near = [f"word{k} of the longer text" for k in range(60)]
    texts = {"same": "a text that stands here twice or more times", "unique": "another text with words of its own", "null": "a text that nobody has numbered", "near": " ".join(near), "nearer": " ".join([*near[:59], "changed"])}
    data = [(1, "same"), (1, "unique"), (5, "same"), (5, "same"), (None, "same"), (None, "null"), (None, "null"), (7, "near"), (7, "nearer"), (None, "nearer"), (3, "three"), (3, "three"), (3, "three")]
    data = [(i, texts.get(k, "the third of these texts is listed thrice"), "en", f"s{n % 3}", n) for n, (i, k) in enumerate(data)]
    docs = spark.createDataFrame(data, DOCS)
    stages = staged(spark, docs, sf_dir)
    as_rows = lambda s: Counter((r["doc_id"], r["text"]) for r in s.collect())
    assert as_rows(stages[1]) == Counter((r[0], r[1]) for r in data)
    assert as_rows(stages[2]) == {(5, texts["same"]): 1, (1, texts["unique"]): 1, (None, texts["null"]): 1, (7, texts["near"]): 1, (7, texts["nearer"]): 1, (3, data[-1][1]): 1}
    kept = Counter({(r[0], r[1]): 1 for r in brute_kept(data, {r[1] for r in data})})
    assert {**as_rows(stages[3])} == {**kept} and sum(kept.values()) == 5
    per = {(r["doc_id"], r["n"]): r for r in mixing.mix(stages[3].withColumnRenamed("n_chars", "n"), keep=["n"]).collect()}
    want = Counter()
    for r in stages[3].collect():
        p = per[r["doc_id"], r["n_chars"]]
        want[r["doc_id"], r["text"]] += int(p["taken"] / p["size"] + 0.5)
    assert as_rows(stages[4]) == +want
    assert Counter(r["doc_id"] for r in stages[5].collect()) == Counter(r["doc_id"] for r in stages[4].collect())


@pytest.mark.parametrize("stage", [cp.mix_sources])
def test_repeated_rows_are_mixed_one_by_one(spark, sf_dir, stage):
    rows = [(5, "the same words again " * 30, "en", "a", 0)] * 3 + [(6, "other words here " * 30, "en", "b", 0)] * 2
    got = Counter(r["doc_id"] for r in stage(spark, spark.createDataFrame(rows, DOCS), sf_dir).collect())
    assert got[5] <= 6 and got[6] <= 4 and sum(got.values()) >= 5


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, 0)], [(1, "", "en", "a", 0), (2, "  ", "en", None, 0)], [(5, "the same words again " * 30, "en", "a", 0)] * 3])
def test_stages_survive_odd_tables(spark, sf_dir, rows):
    docs = spark.createDataFrame(rows, DOCS)
    for c in ("id", "score", "lang_pred", "keep_id", "times", "_copy", "component_id", "size"):
        docs = docs.withColumn(c, F.lit(1))
    docs = docs.withColumn("_no", F.lit("x"))
    stages = staged(spark, docs, sf_dir)
    assert all(set(s.columns) == set(docs.columns) for s in stages[:5])
    assert stages[5].columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
