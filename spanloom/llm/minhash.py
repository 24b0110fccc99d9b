"""Sets of word shingles: similarity, and the pairs that bands of least hashes propose (for operator 3, where fingerprints lie too far apart).

A set has ``BANDS`` keys, each of ``ROWS`` least values under hash functions of its own. Sets of Jaccard similarity s share a key with a
chance of 1 - (1 - s^ROWS)^BANDS: all but 5 in 100,000 at 0.8. Up to ``CROWD`` sets of a key are compared each with each. Beyond that a set
is compared with the least set that it meets under any of its keys; sets of a crowd that are then not yet connected meet once more under
their rarest shingles, in blocks, and are compared by their least values, and whole where these allow the similarity. A block gives only the links that connect what isn't connected in it, so
links of a group grow with its size and not with the square.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.blocks import BLOCK, meetings
from spanloom.llm.common import discard, stage
from spanloom.operators.components import components
from spanloom.operators.joins import lookup_join

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS, CROWD = 25, 5, 2
#: Below the similarity by so much, the share of equal least values rules a pair out: four standard deviations of the estimate at 0.8.
MARGIN = 0.15
#: Shingles up to which a set comes along to where a crowd is compared; pairs of larger ones are decided on afterwards.
ALONG = 512
#: Leaves, those with mid and others, that a set which may meet one that doesn't come along has with it, to tell whether the two meet under an
#: earlier one.
HEADS = 32
#: Buckets in which the shingles of open crowds are counted, for an order from rare to common.
BUCKETS = 1 << 18
#: Elements of a matrix of values by hash functions.
_CELLS = 1 << 20
_rng = np.random.default_rng(42)
_ODD = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of all word shingles; a text of fewer words is one shingle, of no words an empty one."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # as simhash.fingerprint
    h64 = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([h64(b" ".join(words))], np.uint64)
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    of_word = np.array([h64(w) for w in known], np.uint64)[ids]
    n = len(words) - shingle + 1
    out = np.zeros(n, np.uint64)
    for k in range(shingle):
        out = (out ^ of_word[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def sketch(hashes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Of a set: the keys of its bands, and the low 16 bits of its least values."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    step = _CELLS // len(least)
    for at in range(0, len(hashes), step):
        least = np.minimum(least, (hashes[at : at + step, None] * _ODD + _ADD).min(axis=0))
    raw = least.reshape(BANDS, ROWS)
    keys = np.array([xxhash.xxh64_intdigest(band.tobytes(), seed=k) for k, band in enumerate(raw)], np.uint64).view(np.int64)
    return keys, (least >> np.uint64(32)).astype(np.uint16).tobytes()


def slices(batches: Iterator[pd.Series], rows: int = 256) -> Iterator[pd.Series]:
    """Batches cut small, so that what is made of a batch doesn't stand in memory as a whole."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at : at + rows]


def node(hashes: np.ndarray) -> int:
    """Signed hash of a set: equal sets are one node."""
    h = xxhash.xxh64_intdigest(hashes.tobytes())
    return h - (1 << 64) if h >> 63 else h


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets, not both empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _alike(batches: Iterator[pd.DataFrame], least: float) -> Iterator[pd.DataFrame]:
    """Of each block the residents, then those that ask: links between different components whose sets reach the similarity (sure). Those
    that a link joins are one component from then on, so a block gives fewer links than it holds components. Pairs with a set that
    doesn't come along are given where sizes and least values allow the similarity (not sure), but not where their heads show that they
    are under an earlier leaf, too: similar sets share hundreds of leaves."""
    block, homes = None, None
    for batch in batches:
        out: list[tuple[int, int, bool]] = []
        for (leaf, cell), rows in batch.groupby(["leaf", "cell"], sort=True):
            if (leaf, cell >> 1) != block:
                block, homes, joined = (leaf, cell >> 1), None, {}
            own = _Members(rows)
            if not cell & 1:
                homes = own if homes is None else homes.plus(own)
            elif homes is not None:
                for at in range(0, len(rows), 64):
                    out += _links(own.part(at, at + 64), homes, joined, least, leaf)
        yield pd.DataFrame(dict(zip("uv", ([o[k] for o in out] for k in (0, 1)), strict=True)), dtype="int64").assign(sure=np.array([o[2] for o in out], bool))


class _Members:
    """Columns of a block's rows; a set is made of a row's hashes when it is first looked at."""

    def __init__(self, rows: pd.DataFrame):
        self.sig = np.frombuffer(b"".join(rows["sig"]), np.uint16).reshape(len(rows), -1)
        self.n, self.node, self.label, self.mid = (rows[c].to_numpy() for c in ("n", "node", "label", "mid"))
        self.body, self.sets = list(rows["body"]), [None] * len(rows)
        self.heads, self.others = list(rows["heads"]), list(rows["others"])

    def _with(self, change: Callable[[str], object]) -> _Members:
        other = object.__new__(_Members)
        vars(other).update({name: change(name) for name in vars(self)})
        return other

    def part(self, lo: int, hi: int) -> _Members:
        return self._with(lambda name: getattr(self, name)[lo:hi])

    def plus(self, more: _Members) -> _Members:
        both = lambda name: (getattr(self, name), getattr(more, name))
        return self._with(lambda name: both(name)[0] + both(name)[1] if isinstance(both(name)[0], list) else np.concatenate(both(name)))

    def shingles(self, k: int) -> frozenset | None:
        if self.sets[k] is None and self.body[k] is not None:
            self.sets[k] = frozenset(np.asarray(self.body[k]).tolist())
        return self.sets[k]

    def leaves(self, k: int, mid: bool) -> set[int]:
        """Of a row's least leaves those with mid, or all."""
        if self.heads[k] is None:
            return set()
        return set(self.heads[k].tolist()) if mid else {*self.heads[k].tolist(), *self.others[k].tolist()}


def _met_before(a: _Members, k: int, b: _Members, j: int, leaf: int) -> bool:
    """Whether two rows are sure to meet under an earlier leaf: one that both have, the smaller set (of equal ones both) with mid."""
    return min(a.leaves(k, a.n[k] <= b.n[j]) & b.leaves(j, b.n[j] <= a.n[k]), default=leaf) < leaf


def _root(joined: dict[int, int], label: int) -> int:
    while (up := joined.get(label, label)) != label:
        joined[label] = label = joined.get(up, up)
    return label


def _links(rows: _Members, homes: _Members, joined: dict[int, int], least: float, leaf: int) -> list[tuple[int, int, bool]]:
    ok = (rows.sig[:, None] == homes.sig[None]).mean(axis=2) >= least - MARGIN
    small, large = np.minimum.outer(rows.n, homes.n), np.maximum.outer(rows.n, homes.n)
    ok &= (small >= least * large - 1e-9) & (rows.label[:, None] != homes.label[None])
    ok &= np.where(rows.n[:, None] <= homes.n[None], rows.mid[:, None], homes.mid[None]).astype(bool)
    out = []
    for r, c in zip(*(x.tolist() for x in np.nonzero(ok)), strict=True):
        here, there = _root(joined, int(rows.label[r])), _root(joined, int(homes.label[c]))
        if here == there:
            continue
        a, b = rows.shingles(r), homes.shingles(c)
        sure = a is not None and b is not None
        if sure:
            common = len(a & b)
            if common < least * (len(a) + len(b) - common) - 1e-9:
                continue
            joined[max(here, there)] = min(here, there)
        elif _met_before(rows, r, homes, c, leaf):
            continue
        out.append((int(rows.node[r]), int(homes.node[c]), sure))
    return out


def _prefixes(bodies: DataFrame, least: float) -> DataFrame:
    """bodies (node, body) -> (node, token, mid): the first shingles of each set in one order of all shingles, rare ones first, so many that two
    sets that reach the similarity share one: one of the larger set's (n - least * n + 1 of them) that is among the smaller set's with mid
    (n - 2 * least / (1 + least) * n + 1). Any order is right; this one counts shingles in ``BUCKETS`` buckets, a table of fixed size, so
    that shingles of many sets come last.
    """
    bucket = F.explode(F.transform("body", lambda x: x.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")))
    found = bodies.select(bucket.alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("c")).toArrow()  # BUCKETS rows at most
    counts = np.zeros(BUCKETS, np.int64)
    counts[found["b"].to_numpy()] = found["c"].to_numpy()
    shared = bodies.sparkSession.sparkContext.broadcast(counts)

    @F.pandas_udf("array<struct<token:long,mid:boolean>>")
    def first(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in slices(batches):
            out = []
            for body in some:
                body = np.asarray(body)
                n = len(body)
                longest, mid = (n - int(np.ceil(part * n - 1e-6)) + 1 for part in (least, 2 * least / (1 + least)))
                order = np.lexsort((body, shared.value[body & (BUCKETS - 1)]))[:longest]
                out.append([{"token": t, "mid": k < mid} for k, t in enumerate(body[order].tolist())])
            yield pd.Series(out, dtype=object)

    return bodies.select("node", F.explode(first("body")).alias("p")).select("node", "p.token", "p.mid")


def _apart(crowds: DataFrame, sets: DataFrame, bodies: Callable[[DataFrame], DataFrame], links: DataFrame, least: float, block: int) -> DataFrame:
    """Of sets under one crowded key (crowds: key, node, n) that links don't connect: further links (u, v, sure), and the pairs that may
    reach the similarity where a set has more than ``ALONG`` shingles (not sure).

    They meet under the rare shingles of ``_prefixes``: all pairs that reach the similarity do, and sets that only have a common passage
    under a crowded key share none, so that such a crowd costs by its size and not by its pairs.
    """
    comp = components(links).withColumnRenamed("node", "_member")
    labelled = crowds.join(comp, F.col("node") == F.col("_member"), "left").select("key", "node", "n", F.coalesce("component", "node").alias("label"))
    labelled = stage(labelled, "crowds")
    open_keys = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    open_sets = stage(labelled.join(open_keys, "key").select("node", "n", "label").distinct(), "open-nodes")
    body = stage(bodies(open_sets.select("node")), "open-bodies")
    tokens = stage(_prefixes(body, least).join(open_sets, "node"), "open-tokens")
    by_label = tokens.groupBy("token", "label").agg(F.count(F.lit(1)).alias("k"), F.max("mid").alias("mid"))
    main = by_label.groupBy("token").agg(F.max(F.struct("k", "label")).alias("most"), F.count(F.lit(1)).alias("labels"), F.max("mid").alias("_mid")).where("labels > 1 AND _mid").drop("_mid")
    stray = (F.col("label") != F.col("most.label")).alias("stray")
    rest = stage(tokens.join(main, "token").select(F.col("token").alias("leaf"), "node", "n", "label", "mid", stray), "open-crowds")
    along = sets.select("node", "sig").join(rest.select("node").distinct(), "node").join(body.where(F.size("body") <= ALONG), "node", "left")
    least_of = lambda when: F.slice(F.array_sort(F.collect_list(F.when(when, F.col("leaf")))), 1, HEADS)
    heads = rest.where(F.col("n") > least * ALONG - 1).groupBy("node").agg(least_of(F.col("mid")).alias("heads"), least_of(~F.col("mid")).alias("others"))
    along = along.join(heads, "node", "left")
    rest = stage(rest.join(along, "node"), "open-sets")
    fields = ["leaf", "node", "n", "label", "mid", "sig", "body", "heads", "others"]
    laid = meetings(rest.where("stray").select(*fields), rest.select(*fields), block, own="node", inside=False)
    found = stage(laid.mapInPandas(lambda batches: _alike(batches, least), "u long, v long, sure boolean").distinct(), "crowd-links")
    discard(labelled, open_sets, body, tokens, rest)
    return found


def similar_links(sets: DataFrame, bodies: Callable[[DataFrame], DataFrame], least: float = LEAST, crowd: int = CROWD, proposed: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """sets (node, n, keys, sig), distinct nodes -> links (u, v) of nodes whose sets reach the similarity; every two similar sets are connected
    by links. bodies(nodes) gives (node, body), the sets' hashes as longs, once for each of the given nodes; proposed: more pairs (u, v)
    to be decided on."""
    each = sets.select("node", "n", F.explode("keys").alias("key"))
    ends = F.struct("node", "n")
    by_key = each.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min(ends).alias("lo"), F.max(ends).alias("hi")).where("m > 1")
    by_key = stage(by_key.withColumn("rows", F.col("m")), "shared-keys")
    met = stage(lookup_join(each, by_key, "key", "rows", "inner"), "band-keys")
    few = met.where(F.col("m") <= crowd).groupBy("key").agg(F.sort_array(F.collect_list(ends)).alias("g"))
    few = few.select("g", F.posexplode("g").alias("i", "a")).select("a", F.explode(F.slice("g", 1, F.col("i"))).alias("b"))
    fits = (F.col("a.node") != F.col("b.node")) & (F.least("a.n", "b.n") >= least * F.greatest("a.n", "b.n") - 1e-9)
    many = met.where(F.col("m") > crowd).select(ends.alias("a"), F.explode(F.array("lo", "hi")).alias("b")).where(fits)
    found = few.where(fits).unionByName(many.groupBy("a").agg(F.min("b").alias("b")))
    found = found.select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
    if proposed is not None:
        found = found.unionByName(proposed.select("u", "v"))

    # Row by row in the JVM: bodies of long texts never stand in memory by the batch.
    common = F.size(F.array_intersect("a", "b"))
    similarity = common / (F.size("a") + F.size("b") - common)

    def decided(pairs: DataFrame) -> DataFrame:
        pairs = stage(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "similar-pairs")
        body = stage(bodies(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()), "shingle-sets")
        of = lambda end, name: body.select(F.col("node").alias(end), F.col("body").alias(name))
        whole = pairs.join(of("u", "a"), "u").join(of("v", "b"), "v")
        linked = stage(whole.where(similarity >= least - 1e-9).select("u", "v"), "similar-links")
        discard(pairs, body)
        return linked

    links = decided(found)
    discard(by_key)
    crowds = met.where(F.col("m") > crowd).select("key", "node", "n")
    if crowds.isEmpty():
        discard(met)
        return links
    more = _apart(crowds, sets, bodies, links, least, block)
    discard(met)
    links = links.unionByName(more.where("sure").select("u", "v"))
    unsure = more.where("NOT sure").select("u", "v")
    return links if unsure.isEmpty() else links.unionByName(decided(unsure))
