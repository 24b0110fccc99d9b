"""The training-data operators against brute force, on small fixtures with nulls, empty and long texts, ties, repeats and clashing names."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from spanloom.llm import bpe, chat, exact_dedup, langid, licenses, mixing, quality, sharding, simhash, warc
from spanloom.operators.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sample(n=60, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = rng.choice([None, "", "   \n\t", " ".join(rng.choices(WORDS, k=rng.randint(1, 80))), "one\ntwo words\n\nthree " + rng.choice(WORDS)])
        rows.append((i * 3, text, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "é", None, "hot", "hot", "hot"]), 0))
    rows += [(1000 + i, "same text in many copies", "en", "hot", 0) for i in range(20)]
    rows.append((2000, "long " * 30000, "en", "a", 0))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    # Columns that clash with what the operators add or use inside.
    df = spark.createDataFrame(sample(), DOCS)
    for c in ("id", "digest", "n", "keep_id", "h", "fp", "row", "leaf", "_cell", "start", "block", "_at", "host", "lines", "words", "score", "unit", "ids", "_guess"):
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# 1 sharding


def walk(keys, n_shards, vnodes, room):
    """Key by key: wait at a node, let the shard take what it has room for, walk on."""
    nodes = sharding.virtual_nodes(n_shards, vnodes)
    firsts = {}
    for i, (c, _) in enumerate(nodes):
        firsts.setdefault(c, i)
    cells = sorted(firsts)
    queue = []
    for h, key in keys:
        cell = h >> 48
        at = firsts[next((c for c in cells if c >= cell), cells[0])]
        queue.append((at, cell <= cells[-1], h, key, at))
    queue.sort(key=lambda q: (q[0], q[1], q[2] if q[2] < 1 << 63 else q[2], q[3]))
    room, placed = list(room), {}
    while queue:
        left = []
        for q in queue:
            s = nodes[q[4]][1]
            if room[s]:
                room[s] -= 1
                placed[q[3]] = s
            else:
                left.append(q)
        queue = []
        for q in left:
            at = q[4]
            while True:
                at = (at + 1) % len(nodes)
                if room[nodes[at][1]]:
                    break
            queue.append((*q[:4], at))
    return placed


def ring_hash(spark, ids):
    return {r[0]: r[1] % (1 << 64) for r in spark.createDataFrame([(i,) for i in ids], "k long").select("k", F.xxhash64("k")).collect()}


@pytest.mark.parametrize(("n_shards", "vnodes", "slack"), [(16, 64, 0.0), (5, 3, 0.1), (1, 2, 0.0), (7, 40, 0.02)])
def test_ring_equals_key_by_key_walk(spark, n_shards, vnodes, slack):
    ids = list(range(700))
    hashes = ring_hash(spark, ids)
    df = spark.createDataFrame([(i, "x", 9) for i in ids], "doc_id long, _cell string, shard int")
    got = rows(sharding.ring_shards(df, n_shards, vnodes=vnodes, slack=slack))
    room = sharding.capacities(len(ids), n_shards, slack)
    # Within a cell keys stand by their signed hash; cells have equal top bits, so the unsigned order is the same.
    assert {r["doc_id"]: r["shard"] for r in got} == walk([(hashes[i], i) for i in ids], n_shards, vnodes, room)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if not slack:
        sizes = [len(slots[s]) for s in range(n_shards)]
        assert max(sizes) - min(sizes) <= 1


def test_ring_moves_little_when_it_grows(spark):
    df = spark.range(4000).withColumnRenamed("id", "doc_id")
    a, b = ({r["doc_id"]: r["shard"] for r in rows(sharding.ring_shards(df, n, slack=0.1))} for n in (10, 11))
    assert sum(a[k] != b[k] for k in a) < 0.35 * len(a)  # modulo would move ten in eleven


def test_ring_edges(spark, docs, empty):
    got = rows(sharding.ring_shards(docs, 4))
    assert len(got) == docs.count() and {r["_cell"] for r in got} == {"x"}
    assert rows(sharding.ring_shards(empty, 4)) == []
    same = spark.createDataFrame([(7,)] * 50 + [(None,)] * 30, "doc_id long")
    assert sorted(Counter(r["shard"] for r in rows(sharding.ring_shards(same, 4))).values()) == [20] * 4


# 10 exact dedup


def brute_groups(data, best):
    groups = defaultdict(list)
    for r in data:
        groups[r[1] or ""].append(r[0])
    return sorted((r[0], best(groups[r[1] or ""]), len(groups[r[1] or ""]), r[0] == best(groups[r[1] or ""]), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in data)


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: (F.length(t) % 3).cast("string")])
def test_exact_groups(docs, keep, digest):
    """The second digest collides all the time: the byte check must keep different texts apart."""
    got = exact_dedup.exact_groups(docs, keep=keep, digest=digest)
    names = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == brute_groups(sample(), {"min": min, "max": max}[keep])


def test_exact_edges(spark, empty):
    assert exact_dedup.exact_groups(empty).count() == 0
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b")], "doc_id long, text string")
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in rows(exact_dedup.exact_groups(df)))
    assert got == {(1, 1, 3, True): 2, (None, 1, 3, False): 1, (None, None, 1, False): 1}


def test_index_keeps_extremes_over_flushes(spark):
    index = exact_dedup.DigestIndex(spark, "min")
    for ids in ([5, 9], [2], [7]):
        index.flush(spark.createDataFrame([(i, "d") for i in ids], "id long, digest string"))
        index.compact()
    assert [tuple(r) for r in index.compact().select("keep_id", "n").collect()] == [(2, 4)]


def test_index_levels_and_hits(spark):
    """Runs wait on their level until it is full; a flush tells which of its digests it holds twice or the index had."""
    index = exact_dedup.DigestIndex(spark, "max", fanout=2)
    seen, shape = Counter(), []
    for k, digests in enumerate(["ab", "bcc", "d", "ade", "f"]):
        hits = index.flush(spark.createDataFrame([(10 * k + i, d) for i, d in enumerate(digests)], "id long, digest string"))
        assert {r["digest"] for r in hits.collect()} == {d for d in digests if seen[d] or digests.count(d) > 1}
        seen.update(digests)
        shape.append([len(level) for level in index.levels])
    assert shape == [[1], [0, 1], [1, 1], [0, 0, 1], [1, 0, 1]]
    assert {r["digest"] for r in index.lookup(spark.createDataFrame([("a",), ("x",), ("f",)], "digest string")).collect()} == {"a", "f"}
    assert {r["digest"]: (r["keep_id"], r["n"]) for r in index.compact().collect()} == {"a": (30, 2), "b": (10, 2), "c": (12, 2), "d": (31, 2), "e": (32, 1), "f": (40, 1)}
    index.clean()


def test_exact_groups_of_structs(spark):
    """Identifiers may be structs: rows that share a doc_id are told apart."""
    df = spark.createDataFrame([(1, 7, "a"), (1, 8, "a"), (None, 9, "a"), (None, 3, "b"), (None, 4, "b")], "doc_id long, no long, text string")
    got = rows(exact_dedup.exact_groups(df.select(F.struct("doc_id", "no").alias("id"), "text"), id_col="id", keep="max"))
    assert sorted(r["id"]["no"] for r in got if r["kept"]) == [4, 8]


def test_saturated_filter_changes_nothing(docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "bits_for", lambda keys: 1 << 15)
    monkeypatch.setattr("spanloom.llm.common._bit", lambda key, bits: F.pmod(F.xxhash64(key), F.lit(3)))
    got = exact_dedup.exact_groups(docs, keep="min")
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got.collect()) == brute_groups(sample(), min)


# 3 near duplicates


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def union(nodes, pairs):
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    data = []
    for i in range(120):
        words = rng.choices([f"w{k}" for k in range(500)], k=rng.choice([0, 1, 2, 5, 300]))
        data.append((len(data), " ".join(words)))
        for _ in range(rng.randint(0, 3)):
            if len(words) > 100:
                words = list(words)
                words[rng.randrange(len(words))] = "Changed"
                data.append((len(data), "\t".join(words)))
    data += [(9000, None), (9001, "")]
    got = rows(simhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string").withColumn("fp", F.lit(1))))
    fps = {i: brute_fingerprint(t) for i, t in data}
    assert {r["doc_id"]: r["fp"] % (1 << 64) for r in got} == fps
    want = union(fps, [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3])
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert len(set(want.values())) < len(want) - 20


@pytest.mark.parametrize(("radius", "block", "levels"), [(0, 2048, None), (1, 8, None), (2, 8, None), (3, 2048, None), (3, 8, None), (3, 8, 5), (3, 64, 7), (3, 64, 9)])
def test_tree_finds_every_pair(spark, radius, block, levels):
    """Planted pairs at each distance, and one dense ball that overflows its blocks, in trees of any depth."""
    rng = random.Random(radius)
    fps = set()
    for _ in range(300):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(2):
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
            fps.add(x)
    ball = rng.getrandbits(64)
    fps |= {ball ^ 1 << a ^ 1 << b for a in range(20) for b in range(a)}
    fps = dict(enumerate(sorted(fps)))
    number = {x: i for i, x in fps.items()}
    points = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps.values()], "fp long")
    pairs = [(number[r["u"] % (1 << 64)], number[r["v"] % (1 << 64)]) for r in rows(simhash.near_links(points, radius, block=block, levels=levels))]
    want = union(fps, [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= radius])
    assert union(fps, pairs) == want


def test_near_edges(spark, empty):
    assert simhash.near_duplicates(empty).count() == 0
    twice = spark.createDataFrame([(1, "a b c d"), (1, "x y z"), (5, "x y z"), (None, "x y z")], "doc_id long, text string")
    assert [r["component_id"] for r in rows(simhash.near_duplicates(twice))] == [1] * 4


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1040)] + [(3, 3)]
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    got = {r["node"]: r["component"] for r in rows(components(spark.createDataFrame(pairs, "u long, v long")))}
    assert got == union(nodes, [p for p in pairs if p[0] != p[1]])
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# 8 mixing


def fill(sizes, weights, total, most):
    """Reshare the excess until no source is above its cap."""
    target, full = dict.fromkeys(sizes, 0.0), set()
    while True:
        free = [s for s in sizes if s not in full]
        rest = total - sum(most * sizes[s] for s in full)
        for s in free:
            target[s] = rest * weights[s] / sum(weights[x] for x in free)
        over = {s for s in free if target[s] > most * sizes[s] + 1e-9}
        for s in over:
            target[s] = most * sizes[s]
        if not over:
            return target
        full |= over


def test_mix(spark, docs, empty):
    data = sample()
    got = {r["doc_id"]: r for r in rows(mixing.mix(docs))}
    assert len(got) == len(data)
    size = {r[0]: len((r[1] or "").split()) for r in data}
    by = defaultdict(int)
    for r in data:
        by[r[3]] += size[r[0]]
    order = sorted(by, key=lambda s: (s is None, s or ""))
    want = fill(by, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(by.values()), 2)
    taken = defaultdict(int)
    for r in data:
        g = got[r[0]]
        assert (g["size"], g["source_size"]) == (size[r[0]], by[r[3]])
        assert g["target"] == pytest.approx(want[r[3]])
        assert 0 <= g["taken"] <= 2 * g["size"]
        taken[r[3]] += g["taken"]
    for s in by:
        assert abs(taken[s] - want[s]) <= 0.5
    again = {r["doc_id"]: r["taken"] for r in rows(mixing.mix(docs.repartition(7)))}
    assert again == {k: v["taken"] for k, v in got.items()}
    assert mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r["taken"], r["target"]) for r in rows(mixing.mix(blank))] == [(0, 0.0)] * 2


def test_schedule_is_even_and_ranked(spark):
    goals = spark.createDataFrame([("a", 5000.0), ("b", 2500.0), (None, 2500.0)], "source string, target double")
    plan = sorted(rows(mixing.schedule(goals, slots=1000)), key=lambda r: r["slot"])
    assert [r["slot"] for r in plan] == list(range(1000))
    seen = Counter()
    for n, r in enumerate(plan, 1):
        assert r["block_no"] == seen[r["source"]]
        seen[r["source"]] += 1
        assert abs(seen["a"] - n / 2) <= 4  # any stretch from the start is balanced
    assert {(r["blocks"], r["words"]) for r in plan if r["source"] == "a"} == {(seen["a"], 5000)}


def test_a_source_without_a_slot_shares_one(spark):
    goals = spark.createDataFrame([("a", 1e6), ("b", 8.0), ("c", 0.2), (None, 8.0)], "source string, target double")
    plan = rows(mixing.schedule(goals, slots=100))
    assert {s: sum(r["source"] == s for r in plan) for s in ("a", "b", "c", None)} == {"a": 100, "b": 1, "c": 0, None: 1}
    assert all(0 <= r["slot"] < 100 for r in plan)
    assert mixing.schedule(goals.limit(0)).count() == 0


@pytest.mark.parametrize("slots", [1 << 17, 50])
def test_order_of_the_mix(spark, docs, slots):
    """The mix as a list of stretches: what it takes of each document, in blocks that are equal up to a word and follow on each other."""
    data = sample()
    taken = {r["doc_id"]: r["taken"] for r in rows(mixing.mix(docs, slots=slots))}
    order = rows(mixing.mixed_order(docs, slots=slots))
    by, blocks = Counter(), defaultdict(Counter)
    for r in order:
        assert 0 <= r["from_word"] < r["to_word"]
        by[r["doc_id"]] += r["to_word"] - r["from_word"]
        blocks[r["source"]][r["block_no"]] += r["to_word"] - r["from_word"]
    assert by == Counter({i: n for i, n in taken.items() if n})
    assert len(data) == len(taken)
    for per in blocks.values():
        assert max(per.values()) - min(per.values()) <= 1


# 2 language id


def test_language_id(spark, sf_dir, empty):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(df.where(~langid.held_out()))
    got = rows(langid.predict(df.select("doc_id", "text", "lang"), model).withColumn("out", langid.held_out()))
    tested = [r for r in got if r["out"]]
    assert len(tested) > 20
    assert sum(r["lang"] == r["lang_pred"] for r in tested) >= 0.95 * len(tested)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "x" * 100_000), (5, "the " * 50_000)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    found = {r["doc_id"]: r for r in rows(langid.predict(odd, model))}
    assert [found[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert found[4]["lang_pred"] in model.languages
    none = langid.fit(empty)
    assert [r["lang_pred"] for r in rows(langid.predict(odd, none))] == ["und"] * 5


def test_forward_sums_all_segmentations():
    import numpy as np

    pieces = langid.Pieces(["a", "ab", "b", "bc", "abc"])
    probs = np.array([[0.1], [0.2], [0.3], [0.15], [0.05], [0.01], [0.0]])
    value = lambda w: langid.forward(pieces.grid([w]), probs)[-1][0, 0]
    assert value("abc") == pytest.approx(0.05 + 0.1 * 0.15 + 0.2 * 0.01 + 0.1 * 0.3 * 0.01)  # c alone is unknown
    uses = langid.expected(pieces.grid(["ab"]), probs, np.array([2.0]))
    assert uses[1] == pytest.approx(2 * 0.2 / 0.23)
    assert uses[0] == pytest.approx(2 * 0.03 / 0.23)


# 4 chat


def test_chat_round_trip(spark):
    nasty = ["", None, "\\", "<|", "<\\|", "</s>[INST]", "<|end|><|turn|>user<|body|>", "a\\\\<|", "[/INST]\\", "<", "\n😀é"]
    rng = random.Random(2)
    data = [(c, t, rng.choice(["user", "assistant", "system", None, "<|turn|>"]), rng.choice(nasty)) for c in (1, 2, None) for t in [0, 1, 1, 2, 5]]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_part(F.col("text"))).withColumn("seq", F.lit(1))
    done = chat.format_chats(df)
    got = {r["conv_id"]: r for r in rows(done.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_spans"))))}
    for c in (1, 2, None):
        want = sorted([(t, r or "", x or "") for k, t, r, x in data if k == c])
        assert [(t["role"], t["body"]) for t in got[c]["turns"]] == [x[1:] for x in want]
        assert got[c]["loss"] == "".join(x for _, r, x in want if r == "assistant")
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_parts(spark):
    part = lambda kind, text=None, ref=None, tokens=None: (kind, text, ref, tokens)
    data = [
        (1, 0, "user", [part("text", "look <|"), part("image", ref="i.png", tokens=64), part("text", "and"), part("audio", ref="a.wav", tokens=10)]),
        (1, 1, "assistant", [part("document", ref="d.pdf"), part(None, "done")]),
        (1, 2, "user", None),
    ]
    df = spark.createDataFrame(data, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    (r,) = rows(chat.format_chats(df))
    assert r["formatted"] == "<|turn|>user<|body|>look <\\|<|image:1|>and<|audio:2|><|end|><|turn|>assistant<|body|><|document:3|>done<|end|><|turn|>user<|body|><|end|>"
    assert [(a["no"], a["type"], a["ref"], a["tokens"]) for a in r["attachments"]] == [(1, "image", "i.png", 64), (2, "audio", "a.wav", 10), (3, "document", "d.pdf", 0)]
    assert r["expanded_tokens"] == 74
    assert [r["formatted"][s["start"] : s["end"]] for s in r["loss_spans"]] == ["<|document:3|>done"]


# 5 WARC


def test_warc_round_trip(spark):
    data = [(3, "http://a/", "same"), (1, "http://b/\r\nX: y", "same"), (2, None, None), (9, "http://c/", ""), (4, "u", "WARC/1.1\r\n\r\nWARC-Type: x\r\n\r\n"), (5, "u", "é😀" * 40000), (None, "u", "none")]
    path = warc.new_path(spark, "test")
    warc.write_archives(spark.createDataFrame(data, "page_id long, url string, html string").withColumn("digest", F.lit(0)), path)
    got = {r["metadata"][0]["page_id"]: r for r in rows(warc.captures(warc.read_records(spark, path)))}
    kinds = {1: "response", 3: "revisit", 2: "response", 9: "revisit", 4: "response", 5: "response", None: "response"}
    assert set(got) == set(kinds)
    for page, _, html in data:
        main, raw = got[page]["main"], (html or "").encode()
        assert main["warc_type"] == kinds[page]
        assert (main["payload_bytes"], main["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert len(got[page]["requests"]) == len(got[page]["metadata"]) == 1
        if kinds[page] == "response":
            assert bytes(main["block"]).partition(b"\r\n\r\n")[2] == raw and main["digest_ok"]
    assert got[3]["main"]["refers_to"] == got[1]["capture_id"]
    large = warc.new_path(spark, "test")
    warc.write_archives(spark.createDataFrame(data[:2], "page_id long, url string, html string"), large, min_revisit_bytes=5)
    assert {r["main"]["warc_type"] for r in rows(warc.captures(warc.read_records(spark, large)))} == {"response"}


def test_warc_repeated_pages_equal_sql(spark, tmp_path):
    """A page_id with several payloads, repeated rows, null page_ids: a row per row, as the SQL has it."""
    import duckdb

    data = [(1, "aa"), (1, "bbb"), (2, "cc"), (3, "cc"), (3, "cc"), (2, "cc"), (None, "zz"), (None, "zz"), (None, "aa"), (7, None), (6, ""), (None, None), (8, "l" * 70_000), (9, "l" * 70_000)]
    spark.createDataFrame([(i, f"http://{k}", x) for k, (i, x) in enumerate(data)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    cursor = c.execute(warc.OP5_SQL)
    names = [d[0] for d in cursor.description]
    want = Counter(cursor.fetchall())
    got = warc.op5_warc_transactions(spark, str(tmp_path))
    assert Counter(tuple(r[n] for n in names) for r in got.collect()) == want and want.total() == len(data)


def test_warc_many_repeated_payloads(spark, tmp_path, monkeypatch):
    """The way without a broadcast gives the same."""
    spark.createDataFrame([(i, "u", f"page {i % 5}") for i in range(40)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    first = Counter(map(tuple, warc.op5_warc_transactions(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(warc, "FEW_DIGESTS", 0)
    assert Counter(map(tuple, warc.op5_warc_transactions(spark, str(tmp_path)).collect())) == first and first.total() == 40


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_warc_parsed_in_pieces(size):
    raw = b"".join(b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (k, 10 * k, b"\r\nWARC/1.1" * k) for k in range(6))
    whole = list(warc._parse(raw, True))
    assert [len(r[-1]) for r in whole] == [0, 10, 20, 30, 40, 50]
    assert list(warc._parse((raw[at : at + size] for at in range(0, len(raw), size)), True)) == whole
    assert b"".join(warc._inflated(zlib.compress(raw * 90_000, wbits=31))) == raw * 90_000


def test_warc_edges(spark):
    path = warc.new_path(spark, "test")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.captures(warc.read_records(spark, path)).count() == 0
    # A gap: the response is missing, its request is not.
    raw = b"WARC/1.1\r\nWARC-Type: request\r\nWARC-Record-ID: <a>\r\nWARC-Concurrent-To: <b>\r\nContent-Length: 2\r\n\r\nxx\r\n\r\n"
    (r,) = list(warc._parse(zlib.decompress(zlib.compress(raw)), True))
    assert r[:3] == ("a", "request", "b") and r[-1] == b"xx"


# 6 licenses


def brute_scan(text, least):
    words_of = licenses.words_of
    dice = {}
    lines = (text or "").split("\n")
    whole = words_of(" ".join(lines))
    for name, t in licenses.TEMPLATES.items():
        grams = Counter(zip(words_of(t), words_of(t)[1:]))
        units = [words_of(x) for x in lines] + [whole]
        size = len(words_of(t))
        for word, place in licenses.anchors(t, least):
            units += [whole[max(i - place, 0) :][:size] for i, w in enumerate(whole) if w == word]
        for u in units:
            own = Counter(zip(u, u[1:]))
            d = round(2 * (own & grams).total() / max(1, own.total() + grams.total()), 6)
            if d >= least:
                dice[name] = max(dice.get(name, 0), d)
    best = min(((-d, name) for name, d in dice.items()), default=(0.0, None))
    return best[1], -best[0], len(dice)


def wrapped(text, width, mark="# "):
    import textwrap

    return "\n".join(mark + x for x in textwrap.wrap(text, width))


def test_licenses(spark, empty):
    t = licenses.TEMPLATES
    rng = random.Random(9)
    code = "\n".join(f"x{i} = f({i}, y)" for i in range(60))
    odd = t["MIT-full"].split(" ")
    for at in rng.sample(range(len(odd)), 12):
        odd[at] = "changed"
    texts = [None, "", "x", t["MIT"], "word\n" + t["Apache-2.0"].upper() + "\nmore", t["ISC"].replace(", ", "\n"), t["MIT-text"] + " now", "Released under the MIT Licence.", "all rights reserved\n" * 3, "all rights reserved all rights reserved", "word " * 30000]
    texts += [wrapped(t["MIT-text"], 70) + "\n" + code, code + "\n" + wrapped(t["MIT-full"], 78, " * "), "Copyright 2020 Foo. All rights reserved. More words follow here", code.replace("\n", " ") + " " + " ".join(odd) + " " + code, "license " * 5000]
    texts += [wrapped(t["BSD-3-Clause"], 60, "// "), wrapped(t["GPL-3.0-header"], 72, ""), ("filler " * 2040) + wrapped(t["Zlib"], 75) + (" filler" * 3000) + wrapped(t["Apache-2.0-header"], 40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("name", F.lit("x"))
    got = {r["doc_id"]: (r["license"], r["dice"], r["n_matches"]) for r in rows(licenses.scan(df))}
    assert got == {i: brute_scan(x, licenses.LEAST) for i, x in enumerate(texts)}
    assert got[11][:2] == ("MIT-text", 1.0) and got[12][:2] == ("MIT-full", 1.0) and got[13][0] == "proprietary" and got[14][0].startswith("MIT-") and 0.8 <= got[14][1] < 1
    assert licenses.scan(empty).count() == 0
    assert {r["n_matches"] for r in rows(licenses.scan(df, templates={}))} == {0}
    twice = spark.createDataFrame([(1, t["MIT"]), (1, t["MIT"]), (None, t["MIT"])], "doc_id long, text string")
    assert [r["license"] for r in rows(licenses.scan(twice))] == ["MIT"] * 3


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_a_match_has_an_anchor(name):
    """Take all anchors out of a template: what is left is no match, at any admissible size."""
    text = licenses.TEMPLATES[name]
    words, marks = licenses.words_of(text), {w for w, _ in licenses.anchors(text, licenses.LEAST)}
    kept = sum(a not in marks and b not in marks for a, b in zip(words, words[1:]))
    n = len(words) - 1
    for size in range(max(1, licenses.size_bounds(n, licenses.LEAST)[0]), licenses.size_bounds(n, licenses.LEAST)[1] + 1):
        assert 2 * min(kept, size) / (n + size) < licenses.LEAST - 1e-6


# 7 quality


def brute_base(text):
    for c in "\t\x0b\x0c\r":
        text = (text or "").replace(c, " ")
    lines = text.split("\n")
    words = [w for x in lines for w in x.split(" ") if w]
    marked = set()
    at = defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    for where in at.values():
        if len(where) > 1:
            marked |= {i + k for i in where for k in range(8)}
    raw = [x for x in lines if x.strip(" ")]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(raw) - len(set(raw)), len(marked)


def test_quality(spark, docs, empty):
    rng = random.Random(8)
    lines = [" ".join(rng.choices(WORDS, k=9)) for _ in range(30)]
    data = [(i, "\n".join(rng.choices(lines, k=rng.randint(0, 8))), "en", rng.choice(["a", None]), 0) for i in range(150)]
    data += [(500 + i, f"boiler plate line of the  Host\n{' '.join(f'u{i}x{k}' for k in range(30))}", "en", "b", 0) for i in range(20)]
    data += [(600 + i, f"BOILER plate line of the host\n{' '.join(f'z{i}' for k in range(5))} " + " ".join(f"q{i}{k}" for k in range(9)), "en", "b", 0) for i in range(20)]
    got = {r["doc_id"]: r for r in rows(quality.quality_verdicts(spark.createDataFrame(data, DOCS), max_docs=10, max_share=1.0))}
    seen = defaultdict(set)
    norm = lambda x: " ".join(x.lower().split())
    for r in data:
        for x in r[1].split("\n"):
            seen[r[3], norm(x)].add(r[0])
    for r in data:
        g, base = got[r[0]], brute_base(r[1])
        assert tuple(g[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == base
        gone = sum(len(x.split()) for x in r[1].split("\n") if x.strip() and len(seen[r[3], norm(x)]) > 10)
        assert g["removed_words"] == gone
        failed = base[0] < 20 or 100 * base[4] > 30 * base[0]
        assert g["base_failed"] == failed
        assert g["kept"] == (not failed and base[0] - gone >= 20 and base[0] - gone >= 0.5 * base[0])
    assert got[500]["kept"] and not got[600]["kept"]
    text = rows(quality.remove_lines(spark.createDataFrame([(data[150][1], got[500]["removed"]), (None, None)], "text string, removed array<long>")))
    assert text[0]["text"] == data[150][1].split("\n")[1] and text[1]["text"] is None
    assert quality.quality_verdicts(docs).count() == docs.count()
    assert quality.quality_verdicts(empty).count() == 0


@pytest.mark.parametrize("few", [0, quality.FEW_LINES])
def test_line_limits_of_small_and_hot_hosts(spark, few, monkeypatch):
    """A line in 3 documents of a host of 4 stays and one in 4 goes; a fifth of a host of 50; 30 documents of a host however large."""
    monkeypatch.setattr(quality, "FEW_LINES", few)
    data, at = [], iter(range(10**6))
    for host, docs, times in (("tiny", 4, (3, 4)), ("small", 50, (10, 11)), ("hot", 5000, (30, 31, 400))):
        for k in range(docs):
            lines = [f"own words of {host} number {k} " * 6] + [f"shared line of {host} {n} times" for n in times if k < n]
            data.append((next(at), "\n".join(lines), "en", host, 0))
    got = defaultdict(Counter)
    for (_, _, _, host, _), r in zip(data, sorted(rows(quality.quality_verdicts(spark.createDataFrame(data, DOCS))), key=lambda r: r["doc_id"]), strict=True):
        got[host][r["removed_words"]] += 1
    assert got["tiny"] == {6: 4}
    assert got["small"] == {0: 39, 6: 11}
    assert got["hot"] == {0: 4600, 6: 369, 12: 31}


@pytest.mark.parametrize("text", ["", "a " * 7, "a " * 8, "a " * 9, "a b c d e f g h x a b c d e f g h", " ".join(map(str, range(100)))])
def test_repeated_words(text):
    assert quality.repeated_words(text.split()) == brute_base(text)[4]


# 9 BPE


def test_bpe_equals_library(spark, docs, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.TOKENIZER)
    rng = random.Random(4)
    pool = ["a", "aa", "the", "</w>", "<|endoftext|>", "<|startoftext|>", "\x1c", "\x85", "\xa0", "Σ", "ΑΣ", "İ", "é", "½", "中", "😀", "'s", "'LL", " ", "\n", "!!", "ab", "th", "ﬁ", "ß", "\x00", "a" * 50]
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 14))) for _ in range(500)] + ["".join(rng.choices("abcdeinorst", k=rng.randint(1, 60))) for _ in range(500)]
    texts += [r[1] for r in sample()] + ["z" * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("_d", F.lit(1))
    got = {r["doc_id"]: r for r in rows(bpe.digests(df))}
    ids = {r["doc_id"]: r for r in rows(bpe.decode(bpe.encode(df)))}
    for i, text in enumerate(texts):
        want = lib.encode(text or "", add_special_tokens=False).ids
        assert ids[i]["ids"] == want
        back = lib.decode(want, skip_special_tokens=False)
        assert ids[i]["decoded"] == back
        raw = b"".join(x.to_bytes(4, "little") for x in want)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(want), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    assert bpe.digests(empty).count() == 0
