"""The registered queries: SQL oracles, and brute force over whole tables where SQL has no say."""

import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

import __spark_entry__ as entry
from spanloom.llm import registry
from tests.llm.test_ops import brute_fingerprint, fill, union

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, prefix):
    names = [n for n in entry.queries() if n.startswith(prefix)]
    assert len(names) == 1
    return entry.queries()[names[0]](spark, SF)


def test_names():
    names = set(registry.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in entry.queries()


def brute_model(docs, pieces, rounds=2):
    """Piece probabilities per language from plain dictionaries: word counts, forward and backward sums over all segmentations."""
    from spanloom.llm import langid

    index = {p: i for i, p in enumerate(pieces.names)}
    of = lambda run: index.get(run, len(index) if len(run) == 1 else None)
    counts = defaultdict(Counter)
    for r in docs.values():
        if r["lang"] and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            counts[r["lang"]].update(langid.words_of(r["text"]))
    probs = {lang: defaultdict(lambda: 1 / (len(index) + 1)) for lang in counts}
    sums = lambda w, p: list(forward(w, p))

    def forward(word, p):
        total = [1.0]
        for j in range(1, len(word) + 1):
            total.append(sum(total[i] * p[of(word[i:j])] for i in range(max(0, j - 16), j) if of(word[i:j]) is not None))
        return total

    for _ in range(rounds):
        for lang, p in probs.items():
            uses = defaultdict(float)
            for word, n in counts[lang].items():
                ahead = sums(word, p)
                after = [0.0] * len(word) + [1.0]
                for i in range(len(word) - 1, -1, -1):
                    after[i] = sum(p[of(word[i:j])] * after[j] for j in range(i + 1, min(len(word), i + 16) + 1) if of(word[i:j]) is not None)
                for i in range(len(word)):
                    for j in range(i + 1, min(len(word), i + 16) + 1):
                        if of(word[i:j]) is not None:
                            uses[of(word[i:j])] += n * ahead[i] * p[of(word[i:j])] * after[j] / ahead[-1]
            whole = sum(uses.values()) + 0.05 * (len(index) + 1)
            probs[lang] = defaultdict(lambda whole=whole: 0.05 / whole, {k: (x + 0.05) / whole for k, x in uses.items()})
    return probs, sums


def test_language_predictions_equal_brute_force(spark):
    """Every prediction and its score, from a model in plain Python over a small vocabulary."""
    import math

    from spanloom.llm import langid

    df = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 3000").limit(60).select("doc_id", "text", "lang")
    docs = {r["doc_id"]: r for r in df.collect()}
    df = spark.createDataFrame(list(docs.values()), df.schema)
    text = "".join(r["text"] for r in docs.values()).lower()
    names = sorted({"▁", *"abcdefghijklmnopqrstuvwxyz", *(text[i : i + k] for i in range(0, 3000, 7) for k in (2, 3) if not text[i : i + k].isspace() and " " not in text[i : i + k])})
    pieces = langid.Pieces(names)
    original = langid.Pieces.read
    langid.Pieces.read = classmethod(lambda cls, path: pieces)
    try:
        model = langid.fit(df.where(~langid.held_out()), sample_docs=10**6)
    finally:
        langid.Pieces.read = original
    got = {r["doc_id"]: r for r in langid.predict(df, model).collect()}
    probs, sums = brute_model(docs, pieces)
    for i, r in docs.items():
        if not any(map(str.isalpha, r["text"])):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0)
            continue
        logs = {lang: sum(math.log(sums(w, p)[-1]) for w in langid.words_of(r["text"])) for lang, p in probs.items()}
        best = max(sorted(logs), key=lambda k: logs[k])
        assert got[i]["lang_pred"] == best
        assert got[i]["score"] == pytest.approx(1 / sum(math.exp(x - logs[best]) for x in logs.values()), abs=1e-6)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, cursor = registry.queries()[name](spark, SF), c.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    assert Counter(cursor.fetchall()) == Counter(tuple(r[x] for x in columns) for r in got.collect())


def test_shards(spark, docs):
    rows = run(spark, "op1_").collect()
    assert {r["doc_id"] for r in rows} == set(docs) and {r["law"] for r in rows} == {"rows"}
    slots = defaultdict(list)
    for r in rows:
        text = (docs[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["grown_shard"]) == (len(text) + 1, zlib.crc32(text), None)
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(16)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_languages(spark, docs):
    rows = run(spark, "op2_").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in out) >= 0.95 * len(out)


def test_near_duplicates(spark, docs):
    rows = run(spark, "op3_").collect()
    fps = {i: brute_fingerprint(r["text"]) for i, r in docs.items()}
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {i: f"{x:016x}" for i, x in fps.items()}
    want = union(sorted(fps), [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3])
    assert {r["doc_id"]: r["component_id"] for r in rows} == want


def test_mix(spark, docs):
    rows = run(spark, "op8_").collect()
    size = {i: len(r["text"].split()) for i, r in docs.items()}
    by = defaultdict(int)
    for i, r in docs.items():
        by[r["source"]] += size[i]
    target = fill(by, {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(by))}, 1.5 * sum(by.values()), 2)
    taken = defaultdict(int)
    for r in rows:
        assert (r["size"], r["source_size"], r["source"]) == (size[r["doc_id"]], by[r["source"]], docs[r["doc_id"]]["source"])
        assert r["target"] == pytest.approx(target[r["source"]]) and r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in by)


def test_bpe(spark, docs):
    import hashlib

    from tokenizers import Tokenizer

    from spanloom.llm.bpe import TOKENIZER

    lib = Tokenizer.from_file(TOKENIZER)
    for r in run(spark, "op9_").collect():
        ids = lib.encode(docs[r["doc_id"]]["text"] or "", add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
