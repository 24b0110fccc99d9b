"""Every query against its SQL oracle on the smallest tables, and invariants of those that SQL can't express."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = entry.queries(), entry.oracle_sql()


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if value is None or value != value:
        return "null"
    return f"{value:.6g}" if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cursor = duck.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    want = sorted(tuple(plain(row[columns.index(c)]) for c in order) for row in cursor.fetchall())
    assert sorted(tuple(plain(r[c]) for c in order) for r in got.collect()) == want


def test_isoforms_are_walks_of_input_exons(spark):
    rows = QUERIES["g9_isoforms"](spark, SF).collect()
    assert rows
    for r in rows:
        spans = [tuple(map(int, x.split("-"))) for x in r["exons"].split(",")]
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False)) and r["score"] > 0


def test_random_intervals_lie_in_their_space(spark):
    rows = QUERIES["iv12_random_intervals"](spark, SF).collect()
    again = QUERIES["iv12_random_intervals"](spark, SF).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    free = {(r["chrom"], s) for r in rows for s in (r["s"],)}
    assert len(free) > 10


def test_densities_equal_numpy(spark):
    import numpy as np

    from spanloom.operators.classify import cutoffs, log_ratios

    rng = np.random.default_rng(1)
    data = [("l", int(c), float(rng.uniform(1, 5)), float(rng.normal(c, 1)), float(rng.normal(2 * c, 2))) for c in [1] * 80 + [2] * 120 + [0] * 10]
    df = spark.createDataFrame(data, "lib string, cls int, score double, mean_recurrence double, pct double")
    out = log_ratios(df, 0.03)
    got = {(r["mean_recurrence"], r["pct"]): r["log10lr"] for r in out.collect()}
    x = np.array([d[3:] for d in data])
    grids = [np.linspace(x[:, k].min(), x[:, k].max(), 50) for k in (0, 1)]

    def density(c):
        p = np.array([d[3:] for d in data if d[1] == c])
        h = [4 * 1.06 * min(p[:, k].std(ddof=1), np.subtract(*np.percentile(p[:, k], [75, 25])) / 1.34) * len(p) ** -0.2 / 4 for k in (0, 1)]
        kern = [np.exp(-0.5 * ((grids[k][:, None] - p[None, :, k]) / h[k]) ** 2) / np.sqrt(2 * np.pi) / h[k] for k in (0, 1)]
        return kern[0] @ kern[1].T / len(p)

    def at(z, a, b):
        f = [(v - g[0]) / (g[-1] - g[0]) * 49 for v, g in ((a, grids[0]), (b, grids[1]))]
        i, j = (min(int(v), 48) for v in f)
        a, b = f[0] - i, f[1] - j
        return z[i, j] * (1 - a) * (1 - b) + z[i + 1, j] * a * (1 - b) + z[i, j + 1] * (1 - a) * b + z[i + 1, j + 1] * a * b

    mass = {c: sum(d[2] for d in data if d[1] == c) for c in (1, 2)}
    total = sum(mass.values())
    w = (mass[2] / total / 0.95) / (mass[1] / total / 0.03)
    z1, z2 = density(1), density(2)
    for (a, b), lr in got.items():
        assert lr == pytest.approx(np.log10((at(z2, a, b) * w + 1e-10) / (at(z1, a, b) + 1e-10)), abs=1e-6)
    (best,) = cutoffs(out).collect()
    scores = [(got[d[3], d[4]], d[1]) for d in data if d[1]]
    rate = lambda t: (sum(s >= t for s, c in scores if c == 2) / 120 + sum(s < t for s, c in scores if c == 1) / 80) / 2
    assert best["balacc"] == pytest.approx(max(rate(s) for s, _ in scores))
    assert best["auc"] == pytest.approx(sum((a > b) + (a == b) / 2 for a, c in scores for b, d in scores if c == 2 and d == 1) / 9600)


def test_sessions_as_a_stream(spark, tmp_path):
    from spanloom.streaming.sessions import sessions

    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    os.symlink(f"{SF}/events.parquet", tmp_path / "events.parquet")
    stream = spark.readStream.schema(schema).parquet(str(tmp_path))
    q = sessions(stream, "user_id", "ts", "value", "2 hours", "1 day").writeStream.format("memory").queryName("s").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    assert q.awaitTermination(120)
    streamed = {tuple(r) for r in spark.table("s").select("user_id", "start", "n").collect()}
    batch = {tuple(r) for r in sessions(spark.read.parquet(f"{SF}/events.parquet"), "user_id", "ts", "value", "2 hours", "1 day").select("user_id", "start", "n").collect()}
    assert streamed and streamed <= batch
