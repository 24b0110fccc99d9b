"""Operator 13: hard negatives by dual-tree search.

Candidates are dealt to cells of a routing tree and packed into blocks; a block is a tree of vectors, each node with its centre, radius and
range of labels. Anchors are packed into such trees too, near ones together. The inner product of two nodes' vectors lies within
|c||c'| bounds around that of their centres, so a pair of nodes, and with it a whole group of anchors, is left out when the interval misses
all that its anchors still look for: first for pairs of blocks, from their summaries alone, then down both trees. Pairs of leaves are scored
exactly. A search takes two passes: the best scores of the same label, then the best ones within each positive's window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.common import discard, ship, stage, table

#: Vectors of a leaf, of a block, anchors of a block; blocks that meet one block of anchors in a task; summaries of blocks in a tile.
LEAF, BLOCK, ANCHORS, MEET, TILE = 64, 2048, 256, 32, 2048
#: Rows that the routing tree is fitted on, at most; all rows are indexed.
SAMPLE_ROWS = 8192
#: Least and greatest score of a search without bounds.
_LOW, _HIGH = -(1 << 62), 1 << 62


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: float = 256.0) -> DataFrame:
    """(id, label, v): rows with an identifier, a label and a vector without null or non-finite components, whose components become
    floor(scale * x)."""
    x = F.col(vector_col)
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    some = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & F.coalesce(whole, F.lit(False)))
    return some.select(F.col(id_col).alias("id"), F.col(label_col).cast("long").alias("label"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


def _matrix(vectors, width: int) -> np.ndarray:
    """Vectors as rows of equal width, short ones filled with zeros."""
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: in doubles while they can't lose a unit, else in Python's integers (cut to 64 bits)."""
    most = max(1, int(np.abs(a).max(initial=0))) * max(1, int(np.abs(b).max(initial=0))) * max(1, a.shape[1])
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    exact = a.astype(object) @ b.T.astype(object)
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class Tree:
    """A tree of integer vectors: rows in the tree's order, nodes as ranges of rows with centre, radius and range of labels. Node k has the
    children at first[k] and first[k] + 1, or none (0)."""

    def __init__(self, x: np.ndarray, label: np.ndarray):
        self.order = np.arange(len(x))
        self.x, spans, first = x.astype(np.float64), [(0, len(x))], [0]
        for k, (lo, hi) in enumerate(spans):  # grows meanwhile
            if hi - lo > LEAF:
                rows = self.order[lo:hi]
                self.order[lo:hi] = rows[self._split(self.x[rows])]
                first[k], middle = len(spans), (lo + hi) // 2
                spans += [(lo, middle), (middle, hi)]
                first += [0, 0]
        self.spans, self.first = np.array(spans), np.array(first)
        self.x = self.x[self.order]
        labels = label[self.order]
        self.centre = np.array([self.x[lo:hi].mean(axis=0) for lo, hi in spans])
        self.radius = np.array([np.sqrt(((self.x[lo:hi] - c) ** 2).sum(axis=1).max()) for (lo, hi), c in zip(spans, self.centre, strict=True)])
        self.norm = np.sqrt((self.centre**2).sum(axis=1))
        self.labels = np.array([(labels[lo:hi].min(), labels[lo:hi].max()) for lo, hi in spans])

    @staticmethod
    def _split(x: np.ndarray) -> np.ndarray:
        """Rows in the order of their projection on the line between two far rows."""
        far = x[((x - x[0]) ** 2).sum(axis=1).argmax()]
        other = x[((x - far) ** 2).sum(axis=1).argmax()]
        return np.argsort(x @ (far - other), kind="stable")


def _interval(dot, norm_a, radius_a, norm_b, radius_b):
    """Bounds of the inner products of two nodes, wide enough for rounding."""
    slack = radius_a * norm_b + radius_b * norm_a + radius_a * radius_b
    slack = slack + 1e-9 * (norm_a + radius_a) * (norm_b + radius_b) + 1e-6
    return dot - slack, dot + slack


class Search:
    """Best candidates per window of a block of anchors. A window is an anchor's: rows wanted, and the least and greatest score allowed."""

    def __init__(self, anchors: pd.DataFrame, width: int, same: bool, k: int):
        self.same, self.k = same, k
        x, label = _matrix(anchors["v"].tolist(), width), anchors["label"].to_numpy(np.int64)
        self.tree = Tree(x, label)
        at = self.tree.order
        self.x, self.label, self.row, self.id = x[at], label[at], anchors["row"].to_numpy(np.int64)[at], anchors["id"].to_numpy(np.int64)[at]
        windows = anchors["windows"].tolist()
        self.windows = [[dict(no=w["no"], low=w["low"], high=w["high"], best=[]) for w in windows[i]] for i in at]
        self.low = np.array([min((w["low"] for w in ws), default=_HIGH) for ws in self.windows], np.int64)
        self.high = np.array([max((w["high"] for w in ws), default=_LOW) for ws in self.windows], np.int64)

    def scan(self, block: pd.Series, width: int) -> None:
        """All candidates of a block, node pair by node pair."""
        x, label = _matrix(block["v"], width), np.array(block["labels"], np.int64)
        ids, rows = np.array(block["ids"], np.int64), np.array(block["rows"], np.int64)
        tree, mine = Tree(x, label), self.tree
        x, label, ids, rows = x[tree.order], label[tree.order], ids[tree.order], rows[tree.order]
        open_ = [(0, 0)]
        while open_:
            a, b = open_.pop()
            (lo, hi), (other_lo, other_hi) = mine.spans[a], tree.spans[b]
            if self._misses(a, b, tree, lo, hi):
                continue
            wide_a, wide_b = mine.first[a], tree.first[b]
            if not wide_a and not wide_b:
                self._score(lo, hi, x[other_lo:other_hi], label[other_lo:other_hi], ids[other_lo:other_hi], rows[other_lo:other_hi])
            elif wide_b and (not wide_a or other_hi - other_lo >= hi - lo):
                # The more promising half first, so that what is looked for narrows early.
                dots = tree.centre[wide_b : wide_b + 2] @ mine.centre[a]
                open_ += [(a, wide_b + i) for i in np.argsort(dots)]
            else:
                open_ += [(wide_a, b), (wide_a + 1, b)]

    def _misses(self, a: int, b: int, tree: Tree, lo: int, hi: int) -> bool:
        mine, theirs = self.tree.labels[a], tree.labels[b]
        if self.same and (mine[1] < theirs[0] or theirs[1] < mine[0]):
            return True
        if not self.same and mine[0] == mine[1] == theirs[0] == theirs[1]:
            return True
        least, most = _interval(float(self.tree.centre[a] @ tree.centre[b]), self.tree.norm[a], self.tree.radius[a], tree.norm[b], tree.radius[b])
        return most < self.low[lo:hi].min() or least > self.high[lo:hi].max()

    def _score(self, lo: int, hi: int, x, label, ids, rows) -> None:
        scores = _scores(self.x[lo:hi], x)
        fits = (label[None, :] == self.label[lo:hi, None]) == self.same
        fits &= (scores >= self.low[lo:hi, None]) & (scores <= self.high[lo:hi, None])
        if self.same:
            fits &= rows[None, :] != self.row[lo:hi, None]
        for i in np.flatnonzero(fits.any(axis=1)):
            at = np.flatnonzero(fits[i])
            order = at[np.lexsort((rows[at], ids[at], -scores[i, at]))]
            ranked = scores[i, order]
            for w in self.windows[lo + i]:
                begin, end = np.searchsorted(-ranked, [-w["high"], -w["low"]], side="left")
                end = np.searchsorted(-ranked, -w["low"], side="right")
                some = order[begin : min(end, begin + self.k)]
                if len(some):
                    found = zip((-scores[i, some]).tolist(), ids[some].tolist(), rows[some].tolist(), strict=True)
                    w["best"] = sorted([*w["best"], *found])[: self.k]
                    if len(w["best"]) == self.k:
                        w["low"] = max(w["low"], -w["best"][-1][0])
            self.low[lo + i] = min(w["low"] for w in self.windows[lo + i])

    def rows(self) -> Iterator[tuple]:
        for i, ws in enumerate(self.windows):
            for w in ws:
                for score, other, row in w["best"]:
                    yield int(self.row[i]), int(self.id[i]), w["no"], -score, other, row


def _router(sample: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """Hyperplanes (directions, offsets) of a full binary tree, in heap order from 1, that deal the sample evenly to at least so many leaves."""
    depth = max(0, (leaves - 1).bit_length())
    ways, cuts = np.zeros((1 << depth, sample.shape[1])), np.zeros(1 << depth)
    at = np.ones(len(sample), np.int64)
    for node in range(1, 1 << depth):
        x = sample[at == node]
        if len(x) > 1:
            far = x[((x - x[0]) ** 2).sum(axis=1).argmax()]
            ways[node] = far - x[((x - far) ** 2).sum(axis=1).argmax()]
            side = x @ ways[node]
            cuts[node] = np.median(side)
            at[at == node] = 2 * node + (side > cuts[node])
        else:
            at[at == node] = 2 * node
    return ways, cuts


def _route(x: np.ndarray, ways: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    at = np.ones(len(x), np.int64)
    while len(cuts) > 1 and at[0] < len(cuts):
        at = 2 * at + ((x * ways[at]).sum(axis=1) > cuts[at])
    return at


def _cells(vectors: DataFrame, count: int, width: int) -> DataFrame:
    """vectors with cell: leaves for a block of rows each, as far as a sample of SAMPLE_ROWS rows (the least hashes) can tell leaves apart."""
    few = min(max(1, -(-count // BLOCK)), SAMPLE_ROWS // 8)
    if few == 1:
        return vectors.withColumn("cell", F.lit(1).cast("long"))
    share = vectors.where(F.pmod(F.xxhash64("row"), F.lit(max(1, count // SAMPLE_ROWS))) == 0)
    sample = share.select("v", F.xxhash64("row").alias("_h")).orderBy("_h").limit(SAMPLE_ROWS).toPandas()
    ways, cuts = _router(_matrix(sample["v"].tolist(), width).astype(np.float64), few)
    planes = vectors.sparkSession.sparkContext.broadcast((ways, cuts))

    @F.pandas_udf("long")
    def cell(v: pd.Series) -> pd.Series:
        return pd.Series(_route(_matrix(v.tolist(), width).astype(np.float64), *planes.value) if len(v) else [], dtype="int64")

    return vectors.withColumn("cell", cell("v"))


_SUMMARY = "centre array<double>, norm double, radius double, label_lo long, label_hi long"


def _summary(x: np.ndarray, label: np.ndarray) -> tuple:
    x = x.astype(np.float64)
    centre = x.mean(axis=0)
    return centre.tolist(), float(np.sqrt((centre**2).sum())), float(np.sqrt(((x - centre) ** 2).sum(axis=1).max())), int(label.min()), int(label.max())


def _seeds(x: np.ndarray, label: np.ndarray, asks: np.ndarray, k: int) -> list[int]:
    """For the rows at ``asks`` the k-th best score of another row of the same label among x: what a search of all need not go below."""
    scores = _scores(x[asks], x)
    scores[(label[asks][:, None] != label[None, :]) | (asks[:, None] == np.arange(len(x))[None, :])] = _LOW
    return np.sort(scores, axis=1)[:, -k].tolist() if len(x) >= k else [_LOW] * len(asks)


def _blocks(dealt: DataFrame, width: int, k: int) -> DataFrame:
    """One row per block of candidates, with its summary and the seeds of its anchors. Cells of more rows than a block's are dealt out by a
    hash of the row."""
    sizes = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("_n"))  # at most SAMPLE_ROWS / 4 rows
    part = F.pmod(F.xxhash64("row"), F.ceil(F.col("_n") / BLOCK))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        x, label = _matrix(pdf["v"].tolist(), width), pdf["label"].to_numpy(np.int64)
        asks = np.flatnonzero(pdf["anchor"].to_numpy(bool))
        seeds = [{"row": r, "low": s} for r, s in zip(pdf["row"].to_numpy()[asks].tolist(), _seeds(x, label, asks, k), strict=True)]
        row = (f"{pdf['cell'].iloc[0]}:{pdf['part'].iloc[0]}", pdf["row"].tolist(), pdf["id"].tolist(), label.tolist(), pdf["v"].tolist(), seeds, *_summary(x, label))
        return pd.DataFrame([row], columns=["block", "rows", "ids", "labels", "v", "seeds", "centre", "norm", "radius", "label_lo", "label_hi"])

    parts = dealt.join(F.broadcast(sizes), "cell").withColumn("part", part).drop("_n")
    return parts.groupBy("cell", "part").applyInPandas(pack, f"block string, rows array<long>, ids array<long>, labels array<long>, v array<array<long>>, seeds array<struct<row:long,low:long>>, {_SUMMARY}")


def _groups(anchors: DataFrame) -> DataFrame:
    """anchors with group: neighbouring cells together, about ANCHORS rows a group. The counts of a cell's anchors and of those before it come
    from a table with a row per cell."""
    per = anchors.groupBy("cell").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1))  # one row per cell, at most SAMPLE_ROWS / 4
    laid = per.select("cell", "_n", F.coalesce(before, F.lit(0)).alias("_before"))
    at = F.col("_before") + F.pmod(F.xxhash64("row", F.lit(1)), F.col("_n"))
    return anchors.join(F.broadcast(laid), "cell").withColumn("group", F.floor(at / ANCHORS).cast("long")).drop("_n", "_before")


def _reach(anchors: DataFrame, width: int) -> DataFrame:
    """One row per group of anchors: its summary, and the least and greatest score that any of its windows allows."""

    def sum_up(pdf: pd.DataFrame) -> pd.DataFrame:
        x, label = _matrix(pdf["v"].tolist(), width), pdf["label"].to_numpy(np.int64)
        windows = [w for ws in pdf["windows"] for w in ws]
        row = (int(pdf["group"].iloc[0]), *_summary(x, label), min(w["low"] for w in windows), max(w["high"] for w in windows))
        return pd.DataFrame([row], columns=["group", "centre", "norm", "radius", "label_lo", "label_hi", "low", "high"])

    return anchors.groupBy("group").applyInPandas(sum_up, f"group long, {_SUMMARY}, low long, high long")


def _pairs(groups: DataFrame, blocks: DataFrame, same: bool, tiles_a: int, tiles_b: int) -> DataFrame:
    """(group, block) whose interval of scores meets what the group looks for. Summaries only, in tiles of a bounded number of either."""
    tile = lambda df, key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    left = groups.withColumn("i", tile(groups, "group", tiles_a)).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(tiles_b - 1))))
    right = blocks.select("block", "centre", "norm", "radius", "label_lo", "label_hi").withColumn("j", tile(blocks, "block", tiles_b)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(tiles_a - 1))))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"group": pd.Series(dtype="int64"), "block": pd.Series(dtype=object)})
        col = lambda df, c: df[c].to_numpy()
        dots = np.stack(a["centre"]) @ np.stack(b["centre"]).T
        least, most = _interval(dots, col(a, "norm")[:, None], col(a, "radius")[:, None], col(b, "norm")[None], col(b, "radius")[None])
        keep = (most >= col(a, "low")[:, None]) & (least <= col(a, "high")[:, None])
        a_lo, a_hi, b_lo, b_hi = col(a, "label_lo")[:, None], col(a, "label_hi")[:, None], col(b, "label_lo")[None], col(b, "label_hi")[None]
        keep &= (a_hi >= b_lo) & (b_hi >= a_lo) if same else ~((a_lo == a_hi) & (b_lo == b_hi) & (a_lo == b_lo))
        x, y = np.nonzero(keep)
        return pd.DataFrame({"group": col(a, "group")[x], "block": col(b, "block")[y]})

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(meet, "group long, block string")


def best_within(anchors: DataFrame, blocks: DataFrame, width: int, same: bool, k: int) -> DataFrame:
    """(row, id, no, rank, other_id, score): per window ``no`` of each anchor (row, id, label, v, group, windows) the k best candidates within
    its bounds, of the same label (other rows) or of other labels. A task holds one group of anchors and at most about MEET blocks."""
    groups = stage(_reach(anchors, width), "anchor-groups")
    tiles = [max(1, -(-df.count() // TILE)) for df in (groups, blocks)]
    pairs = stage(_pairs(groups, blocks, same, *tiles), "block-pairs")
    per = pairs.groupBy("group").agg(F.count(F.lit(1)).alias("_n"))
    dealt = stage(pairs.join(per, "group").withColumn("slice", F.pmod(F.xxhash64("block"), F.ceil(F.col("_n") / MEET))).drop("_n"), "dealt-pairs")
    left = dealt.select("group", "slice").distinct().join(anchors.select("group", "row", "id", "label", "v", "windows"), "group")
    right = dealt.select("block", F.col("group").alias("g"), F.col("slice").alias("s")).join(blocks.select("block", "rows", "ids", "labels", "v"), "block")

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = Search(a, width, same, k)
        for _, block in b.iterrows():
            found.scan(block, width)
        return pd.DataFrame(list(found.rows()), columns=["row", "id", "no", "score", "other_id", "other_row"])

    scored = left.groupBy("group", "slice").cogroup(right.groupBy("g", "s")).applyInPandas(search, "row long, id long, no int, score long, other_id long, other_row long")
    order = W.partitionBy("row", "no").orderBy(F.desc("score"), "other_id", "other_row")
    out = stage(scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best-scores")
    discard(groups, pairs, dealt)
    return out.select("row", "id", "no", "rank", "other_id", "score")


def hard_negatives(vectors: DataFrame, is_anchor, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    vectors: (id, label, v) of integers without nulls, see ``integer_vectors``; is_anchor: a condition on id. An anchor's positives are the
    best other rows of its label, and a positive's negatives the best rows of other labels whose score is from low to high hundredths of the
    positive's. Scores are inner products (vectors of different lengths: short ones end in zeros); ties go to the smaller id, equal ids
    count as rows of their own in an unspecified order. An anchor without positives or fitting negatives gives no rows; neither does an
    empty table. Scores beyond 64 bits are cut to them.
    """
    ship(vectors.sparkSession)
    kept = stage(vectors.select("id", "label", "v").withColumn("row", F.monotonically_increasing_id()), "vectors")
    count, width = kept.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    width = max(1, width)
    dealt = stage(_cells(kept, count, width).withColumn("anchor", F.coalesce(is_anchor(F.col("id")), F.lit(False))), "cells")
    blocks = stage(_blocks(dealt, width, positives), "blocks")
    anchors = stage(_groups(dealt.where("anchor")), "anchors")
    seeds = blocks.select(F.explode("seeds").alias("_s")).select("_s.row", F.array(F.struct(F.lit(0).alias("no"), F.col("_s.low").alias("low"), F.lit(_HIGH).alias("high"))).alias("windows"))
    best = best_within(stage(anchors.join(seeds, "row"), "seeds"), blocks, width, True, positives)
    # Scores from low to high hundredths, in whole numbers; of a negative score there are none.
    least, most = F.expr(f"(cast(score AS decimal(30)) * {low} + 99) div 100"), F.expr(f"(cast(score AS decimal(30)) * {high}) div 100")
    window = F.struct(F.col("rank").alias("no"), least.cast("long").alias("low"), most.cast("long").alias("high"))
    windows = best.where("score >= 0").groupBy("row").agg(F.collect_list(window).alias("windows"))
    found = best_within(stage(anchors.join(windows, "row"), "windows"), blocks, width, False, negatives)
    positive = best.select("row", F.col("rank").alias("no"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(positive, ["row", "no"]).select(F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    vectors = vectors.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(vectors, lambda i: i % 100 == 0)


OP13_SQL = """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM v AS a JOIN v AS b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS INTEGER) AS rank, s.b AS negative_id,
  p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) <= 5
"""
