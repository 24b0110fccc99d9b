"""Binned scans and joins against brute force, with bins far smaller than the intervals, so that everything crosses bins."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from spanloom.operators import intervals as iv
from spanloom.operators import joins
from spanloom.operators.filters import aggregate_filter, global_rank, set_attr, strands_agree
from spanloom.operators.stats import auc, left_ecdf_rank, step_lookup


def sample(seed, n=120, span=4000):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = rng.randrange(span)
        rows.append((i, rng.choice("ab"), s, s + rng.choice([1, 5, 30, 400])))
    return rows + [(n + i, *rows[i][1:]) for i in range(min(n, 10))]  # equal intervals


def frame(spark, rows, name="id"):
    return spark.createDataFrame(rows, f"{name} long, chrom string, s long, e long")


@pytest.mark.parametrize(("seed", "dist", "width"), [(1, 0, 50), (2, 10, 7), (3, 0, 1 << 20)])
def test_islands(spark, seed, dist, width):
    rows = sample(seed)
    got = {r["id"]: r["island"] for r in iv.islands(frame(spark, rows), ["chrom"], dist, order=["id"], width=width).collect()}
    want = {}
    for chrom in "ab":
        no, reach = 0, None
        for i, _, s, e in sorted((r for r in rows if r[1] == chrom), key=lambda r: (r[2], r[3], r[0])):
            if reach is None or s > reach + dist:
                no += 1
            reach = e if reach is None else max(reach, e)
            want[i] = no
    assert got == want


@pytest.mark.parametrize(("seed", "width"), [(4, 20), (5, 1 << 14)])
def test_overlap_join(spark, seed, width):
    a, b = sample(seed, 60), sample(seed + 50, 60)
    pairs = joins.overlap_join(frame(spark, a), frame(spark, b), ["chrom"], width=width).select("id", "b_id").collect()
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < y[3] and y[2] < x[3])
    assert sorted(map(tuple, pairs)) == want
    kept = joins.overlap_join(frame(spark, a), frame(spark, b), ["chrom"], keep_all=["id"], width=width).select("id", "b_id").collect()
    alone = {x[0] for x in a} - {i for i, _ in want}
    assert sorted(((r["id"], r["b_id"] is None) for r in kept if r["b_id"] is None)) == sorted((i, True) for i in alone)


@pytest.mark.parametrize(("seed", "width", "most"), [(6, 30, 500), (7, 1 << 20, 60), (8, 11, 10_000)])
@pytest.mark.parametrize("side", ["left", "right"])
def test_nearest(spark, seed, width, most, side):
    a, b = sample(seed, 40), sample(seed + 50, 15)
    got = joins.nearest(frame(spark, a), frame(spark, b, "other"), "chrom", side, most, "id", "other", width=width)
    want = {}
    for i, chrom, s, e in a:
        gaps = [(s - y[3] if side == "left" else y[2] - e, y[0]) for y in b if y[1] == chrom]
        gaps = [g for g in gaps if 1 <= g[0] <= most]
        if gaps:
            want[i] = min(gaps)
    assert {r["id"]: (r["dist"], r["other"]) for r in got.collect()} == want


def test_nearest_within_ranks_both_sides(spark):
    a, b = sample(9, 20), sample(59, 40)
    got = defaultdict(list)
    for r in joins.nearest_within(frame(spark, a), frame(spark, b, "other"), ["chrom"], 3, 300, "id", "other").collect():
        got[r["id"], r["side"]].append((r["rank"], r["dist"], r["near_other"]))
    for i, chrom, s, e in a:
        for side in ("left", "right"):
            gaps = sorted((s - y[3] if side == "left" else y[2] - e, y[0]) for y in b if y[1] == chrom)
            want = [(k, *g) for k, g in enumerate([g for g in gaps if 1 <= g[0] <= 300][:3], 1)]
            assert sorted(got[i, side]) == want


def test_segments_partition_intervals(spark):
    rows = sample(10, 40, 600)
    cut = defaultdict(list)
    for r in iv.segments(frame(spark, rows), ["chrom"]).collect():
        cut[r["id"]].append((r["seg_s"], r["seg_e"]))
    for i, chrom, s, e in rows:
        parts = sorted(cut[i])
        assert parts[0][0] == s and parts[-1][1] == e and all(x[1] == y[0] for x, y in zip(parts, parts[1:], strict=False))
        inside = {p for r in rows if r[1] == chrom for p in r[2:] if s < p < e}
        assert len(parts) == len(inside) + 1


def test_complement_and_footprint(spark):
    rows = sample(11, 30)
    sizes = spark.createDataFrame([("a", 5000), ("b", 5000), ("c", 77)], "chrom string, size long")
    free = defaultdict(set)
    for r in iv.complement(frame(spark, rows).select("chrom", "s", "e"), sizes).collect():
        free[r["chrom"]] |= set(range(r["s"], r["e"]))
    used = {c: {p for r in rows if r[1] == c for p in range(r[2], r[3])} for c in "abc"}
    assert free["a"] == set(range(5000)) - used["a"] and free["b"] == set(range(5000)) - used["b"] and free["c"] == set(range(77))
    assert {r["chrom"]: r["bases"] for r in iv.footprint(frame(spark, rows), ["chrom"]).collect()} == {c: len(used[c]) for c in "ab"}


def test_random_intervals_fit(spark):
    space = spark.createDataFrame([("a", 0, 100), ("a", 500, 520), ("b", 10, 1000)], "chrom string, s long, e long")
    wanted = spark.createDataFrame([(i, 15) for i in range(300)], "no long, length long")
    rows = iv.random_intervals(space, wanted, seed=1).collect()
    homes = [("a", 0, 100), ("a", 500, 520), ("b", 10, 1000)]
    assert len(rows) == 300 and all(any(r["chrom"] == c and s <= r["s"] and r["e"] <= e for c, s, e in homes) for r in rows)
    assert 0.75 < sum(r["chrom"] == "b" for r in rows) / 300 < 1


def test_random_intervals_are_exact(spark, monkeypatch):
    """A row for each length, though draws that don't fit would mostly fail; every start as likely as any other; trees of several levels."""
    regions = [("a", 100 * i, 100 * i + 60) for i in range(300)]
    space = spark.createDataFrame(regions, "chrom string, s long, e long")
    wanted = [(i, 59) for i in range(1000)] + [(1000, 70), (1001, None), (1002, -1), (1003, 0), (1003, 0)]
    for fan in (256, 4):
        monkeypatch.setattr(iv, "FAN", fan)
        rows = iv.random_intervals(space, spark.createDataFrame(wanted, "no long, length long"), seed=2).collect()
        assert len(rows) == 1005 and {r["no"] for r in rows if r["chrom"] is None} == {1000, 1001, 1002}
        placed = [r for r in rows if r["no"] < 1000]
        assert all(r["e"] - r["s"] == 59 and r["s"] % 100 in (0, 1) for r in placed)
        assert 400 < sum(r["s"] % 100 for r in placed) < 600 and len({r["s"] // 100 for r in placed}) > 250
    one = spark.createDataFrame([("b", 5, 8), ("c", 0, 2)], "chrom string, s long, e long")
    many = spark.createDataFrame([(i, 2) for i in range(3000)], "no long, length long")
    counts = Counter((r["chrom"], r["s"]) for r in iv.random_intervals(one, many).collect())
    assert set(counts) == {("b", 5), ("b", 6), ("c", 0)} and all(850 < n < 1150 for n in counts.values())
    assert iv.random_intervals(one.where("s > 9"), many.limit(3)).where("chrom IS NULL").count() == 3
    assert iv.random_intervals(one, many.limit(0)).count() == 0


def test_segments_of_dense_bins(spark):
    """Cuts numbered over many bins, equal and empty spans, many spans under one start."""
    rnd = random.Random(8)
    rows = [(i, "ab"[i % 2], s, s + n) for i in range(400) for s, n in [(rnd.choice([0, rnd.randrange(3000)]), rnd.choice([0, 1, 5, 900]))]] + [(900, "a", 0, 900), (901, "a", 0, 900)]
    df = spark.createDataFrame(rows, "id long, chrom string, s long, e long")
    got = Counter((r["id"], r["seg_s"], r["seg_e"]) for r in iv.segments(df, ["chrom"], width=64).collect())
    cuts = {c: sorted({x for _, k, s, e in rows if k == c for x in (s, e)}) for c in "ab"}
    assert got == Counter((i, a, b) for i, c, s, e in rows for a, b in zip(cuts[c], cuts[c][1:], strict=False) if s <= a and b <= e)


def test_empty_tables(spark):
    none = frame(spark, [])
    some = frame(spark, sample(12, 5))
    assert iv.clusters(none, ["chrom"]).count() == iv.segments(none, ["chrom"]).count() == 0
    assert joins.overlap_join(none, some, ["chrom"]).count() == joins.overlap_join(some, none, ["chrom"]).count() == 0
    assert joins.nearest(some, none.withColumnRenamed("id", "other"), "chrom", "left", 10, "id", "other").count() == 0


def test_global_rank_and_step_lookup(spark):
    rng = random.Random(3)
    values = [(i, rng.randrange(50)) for i in range(500)]
    got = {r["id"]: r["pos"] for r in global_rank(spark.createDataFrame(values, "id long, v long"), ["v", "id"], "pos").collect()}
    assert got == {i: k for k, (_, i) in enumerate(sorted((v, i) for i, v in values), 1)}
    steps = spark.createDataFrame([(float(x * 9000), float(x)) for x in range(5)], "x double, y double")
    points = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 8999.0, 9000.0, 30000.0, 1e9)], "x double")
    look = lambda side: [r["y"] for r in sorted(step_lookup(points, steps, "x", "y", -1.0, side).collect())]
    assert look("right") == [-1.0, 0.0, 0.0, 1.0, 3.0, 4.0] and look("left") == [-1.0, -1.0, 0.0, 0.0, 3.0, 4.0]


def test_ranks_with_ties(spark):
    df = spark.createDataFrame([("l", v) for v in (3, 3, 1, 4)], "lib string, score long")
    assert sorted(r["pct"] for r in left_ecdf_rank(df, "lib", "score").collect()) == [0.0, 25.0, 25.0, 75.0]
    rows = spark.createDataFrame([("g", 1.0, False), ("g", 1.0, True), ("g", 2.0, True), ("h", 1.0, True)], "g string, x double, y boolean")
    assert {r["g"]: r["auc"] for r in auc(rows, "g", "x", "y").collect()} == {"g": 0.75, "h": None}


def test_filters(spark):
    tx = spark.createDataFrame([("a", [(0, 10), (100, 400), (500, 505)]), ("b", [(0, 10)]), ("c", [(0, 250)])], "tid string, exons array<struct<s:long,e:long>>")
    got = {r["tid"]: (r["s"], r["e"], r["length"], r["clipped"], r["too_short"]) for r in aggregate_filter(tx).collect()}
    assert got == {"a": (100, 400, 300, True, False), "b": (0, 10, 10, False, True), "c": (0, 250, 250, False, True)}
    attrs = spark.sql("SELECT map('k', 'v') AS attrs")
    assert set_attr(attrs, "k", "w", force=True).first()["attrs"] == {"k": "w"}
    with pytest.raises(Exception, match="exists"):
        set_attr(attrs, "k", "w").collect()
    pairs = spark.createDataFrame([("+", "+"), ("+", "-"), (".", "-")], "a string, b string")
    assert [r[0] for r in pairs.select(strands_agree(F.col("a"), F.col("b"))).collect()] == [True, False, True]


def test_best_stretch_window_equals_bases(spark):
    from spanloom.operators.stats import best_stretch_window

    rnd, rows = random.Random(6), []
    for f in range(30):
        at = rnd.randrange(5)
        for _ in range(rnd.randint(1, 9)):
            end = at + rnd.choice([1, 2, 7, 30])
            rows.append((f, at, end, rnd.choice([None, float("nan"), 1.0, rnd.uniform(-3, 9)])))
            at = end + rnd.choice([0, 0, 0, 4])
    got = {r["f"]: r["best"] for r in best_stretch_window(spark.createDataFrame(rows, "f long, s long, e long, value double"), "f", 6).collect()}
    for f in {r[0] for r in rows}:
        base = {p: v for g, s, e, v in rows if g == f and v is not None and v == v for p in range(s, e)}
        means = [sum(base[p + k] for k in range(6)) / 6 for p in base if all(p + k in base for k in range(6))]
        assert got[f] == (pytest.approx(max(means)) if means else None)
