"""Operator 3: SimHash near-duplicates, linked through vantage-point trees over Hamming distance.

Fingerprints within ``radius`` (3 at most) of each other differ by at most one bit in one half of their 64 bits, so each half has a tree of
its own. A node of a tree has its own vantage point and splits by the distance to it; a leaf is the path of these distances. By the triangle
inequality a half within 1 bit of another is, at every node, at the same distance (equal halves) or exactly one nearer or farther (one
bit): a fingerprint asks its own leaf and the boundary leaves of all such steps, and no other leaf can hold a partner. Of two halves one
bit apart just one has even parity, and only that one asks abroad. Each leaf then compares whole fingerprints, in blocks, and reports the
components that it sees (a star per component, not all pairs); these links are joined into components over all leaves.

With ``least``, links are decided by the Jaccard similarity of the sets of word shingles. At a similarity of 0.8 fingerprints lie 4 to 16
bits apart, where the bounds of a tree over 64 bits prune next to nothing; so bands of least hashes (minhash.py) propose what the trees
don't reach, and whole sets decide on what either proposes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import minhash
from spanloom.llm.blocks import BLOCK, meetings
from spanloom.llm.common import bits_for, discard, give_back, key_bits, may_hold, ship, stage, table
from spanloom.operators.components import components
from spanloom.operators.joins import lookup_join

_BASE = 40  # distances within a half, with room for the steps: 0 to 33
_MOST_LEVELS = 11  # a path fits a long


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all word shingles, as an unsigned integer; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII case and white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    h64, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, 50_000):
        part = words[at : at + 50_000 + shingle - 1]
        grams = zip(*(part[k:] for k in range(shingle)), strict=False) if len(words) >= shingle else [part]
        hashes = np.array([h64(b" ".join(g), seed) for g in grams], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): fp holds the 64 bits as a signed long. One row per row of docs."""
    ship(docs.sparkSession)

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return docs.select(F.col(id_col).alias("id"), simhash(F.col(text_col)).alias("fp"))


def tree_levels(n: int) -> int:
    """Each level thins a leaf about tenfold and doubles the leaves that are asked; a leaf is to hold about a hundred residents."""
    return min(_MOST_LEVELS, max(4, math.ceil(math.log10(max(n, 1) / 500))))


def _tree(fp: Column, half: int, levels: int) -> tuple[Column, Column]:
    """Of one half's tree: the home leaf, and the array of boundary leaves that this fingerprint asks (null where its partner asks instead)."""
    mask, base, one = F.lit((1 << 32) - 1), F.lit(_BASE).cast("long"), F.lit(1).cast("long")
    depth, root = F.array(*map(F.lit, range(levels))), F.lit(half + 1).cast("long")
    block = F.shiftrightunsigned(fp, 32 * half).bitwiseAND(mask)

    def child(path: Column, step: Column) -> Column:
        """The path to the child at this distance, moved by step - 1. A node's vantage point is a hash of the path to it."""
        point = F.xxhash64(path, F.lit(half)).bitwiseAND(mask)
        return path * base + F.bit_count(block.bitwiseXOR(point)) + step

    home = F.aggregate(depth, root, lambda path, _: child(path, one))
    moved = lambda path: F.transform(F.array(one - 1, one + 1), lambda step: child(path, step))
    abroad = F.aggregate(depth, F.array(root), lambda paths, _: F.flatten(F.transform(paths, moved)))
    return home, F.when(F.bit_count(block) % 2 == 0, abroad)


def _stars(rows: np.ndarray, homes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) that join whatever is within radius among rows and homes: a star per component of each slab of rows, not all pairs."""
    us, vs = [rows[:0]], [rows[:0]]
    for at in range(0, len(rows), 512):
        slab = rows[at : at + 512]
        near = np.bitwise_count(slab.view(np.uint64)[:, None] ^ homes.view(np.uint64)[None]) <= radius
        r, c = (x.astype(np.int32) for x in np.nonzero(near)) if near.sum() <= 8 * sum(near.shape) else (None, None)
        if r is not None:
            other = slab[r] != homes[c]
            us.append(np.maximum(slab[r], homes[c])[other])
            vs.append(np.minimum(slab[r], homes[c])[other])
            continue
        top, low, label, old = np.iinfo(np.int64).max, slab, homes, None
        while old is None or (label != old).any():
            old = label
            low = np.minimum(low, np.where(near, label[None], top).min(axis=1))
            label = np.minimum(label, np.where(near, low[:, None], top).min(axis=0))
        for node, least in ((slab, low), (homes, label)):
            us.append(node[node != least])
            vs.append(least[node != least])
    return np.concatenate(us), np.concatenate(vs)


def _search(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Rows come sorted by leaf and cell: of each block the residents, then those that ask, which stream past them."""
    block, homes = None, np.empty(0, np.int64)
    for batch in batches:
        leaf, cell, fps = batch["leaf"].to_numpy(), batch["cell"].to_numpy(), batch["fp"].to_numpy()
        new = np.r_[True, (leaf[1:] != leaf[:-1]) | (cell[1:] != cell[:-1])] if len(leaf) else np.empty(0, bool)
        starts = np.flatnonzero(new)
        found = []
        for lo, hi in zip(starts, [*starts[1:], len(leaf)], strict=True):
            own, rows = (leaf[lo], cell[lo] >> 1), fps[lo:hi]
            if own != block:
                block, homes = own, rows[:0]
            if cell[lo] & 1:
                if len(homes):
                    found.append(_stars(rows, homes, radius))
                continue
            homes = np.concatenate([homes, rows])
            if len(homes) > 1:
                found.append(_stars(rows, homes, radius))
        u, v = (np.concatenate([f[k] for f in found]) if found else fps[:0] for k in (0, 1))
        yield pd.DataFrame({"u": u, "v": v}).drop_duplicates()


def near_links(points: DataFrame, radius: int = 3, block: int = BLOCK, levels: int | None = None) -> DataFrame:
    """points (fp), distinct -> links (u, v) between fingerprints whose components are those of all pairs within radius (3 at most).
    levels: depth of the trees, by the number of points where it is not given."""
    if not 0 <= radius <= 3:
        raise ValueError("two halves and steps of one bit cover radius 0 to 3")
    ship(points.sparkSession)
    levels = levels or tree_levels(points.count())
    trees = [_tree(F.col("fp"), half, levels) for half in (0, 1)]
    residents = points.select("fp", F.explode(F.array(*(home for home, _ in trees))).alias("leaf"))
    none = F.array().cast("array<bigint>")
    asked = points.select("fp", F.explode(F.concat(*(F.coalesce(abroad, none) for _, abroad in trees))).alias("leaf"))
    laid = meetings(residents, asked, block, own="fp", inside=True)
    return laid.mapInPandas(lambda batches: _search(batches, radius), "u long, v long")


def _classes(marked: DataFrame, node: str, reps: DataFrame, links: DataFrame) -> DataFrame:
    """marked (id, node) with component_id: the smallest identifier that links reach. reps: (node, rep, m), staged, one row per node."""
    # One identifier can stand for several texts: what these link is linked too.
    shared = marked.groupBy("id").agg(F.min(node).alias("v"), F.max(node).alias("w")).where("v <> w AND id IS NOT NULL")
    twins = marked.join(shared, "id").select(F.col(node).alias("u"), "v")
    comp = components(links.unionByName(twins)).withColumnRenamed("node", "_member")
    linked = reps.join(comp, F.col(node) == F.col("_member")).select(node, "rep", "component")
    lowest = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = linked.join(lowest, "component").select(node, "component_id")
    known = reps.join(named, node, "left").select(node, "m", F.coalesce("component_id", "rep").alias("component_id"))
    return lookup_join(marked, stage(known, "classes"), node, "m")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, least: float | None = None) -> DataFrame:
    """One row per row of docs: id_col, fp (signed long), component_id (smallest identifier reachable through links, itself included).

    Without least, fingerprints within radius link: a null or empty text has fingerprint 0 and links like any other, equal fingerprints
    always link. With least, texts link whose sets of shingles have a Jaccard similarity of least or more: texts that differ in
    case and white space only are equal, texts without words are equal to each other.

    Identifiers are of any type that has an order; rows that repeat one share its links. A null identifier can't be named by a component:
    its rows get the smallest identifier that their text reaches, null if there is none. An empty table gives an empty result; other
    columns are ignored. Only with least are texts read again: those of which a pair was proposed.
    """
    if least is None:
        marked = stage(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
        reps = stage(marked.groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("m")), "fingerprint-reps")
        known = _classes(marked, "fp", reps, near_links(reps.select("fp"), radius))
        return known.select(F.col("id").alias(id_col), "fp", "component_id")
    ship(docs.sparkSession)

    @F.pandas_udf("fp long, node long, n long, keys array<long>, sig binary")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from give_back(sketches(batches))

    def sketches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in minhash.slices(batches):
            sets = [minhash.shingles(t, shingle) for t in texts]
            out = pd.DataFrame([(minhash.node(s), len(s), *minhash.sketch(s)) for s in sets], columns=["node", "n", "keys", "sig"])
            out.insert(0, "fp", np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))
            yield out

    @F.pandas_udf("node long, body array<long>")
    def whole(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from give_back(sets_of(batches))

    def sets_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in minhash.slices(batches):
            sets = [minhash.shingles(t, shingle) for t in texts]
            yield pd.DataFrame({"node": [minhash.node(s) for s in sets], "body": [s.view(np.int64) for s in sets]})

    # Else a filter on what it returns (not null) would be moved below the joins, and sets be made of all texts.
    whole = whole.asNondeterministic()

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = stage(texts.select("id", sketch("text").alias("k")).select("id", "k.*"), "sketches")
    firsts = [F.first(c).alias(c) for c in ("n", "keys", "sig")]
    reps = stage(marked.groupBy("node").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("m"), *firsts), "sketch-reps")
    # The wide table goes: from here on only these columns of it are read.
    wide, marked = marked, stage(marked.select("id", "fp", "node"), "nodes")
    discard(wide)
    # What the trees propose, told by sets: a fingerprint stands for the least of its sets, and is proposed to the others.
    by_fp = stage(marked.groupBy("fp").agg(F.min("node").alias("first"), F.max("node").alias("last")), "set-of-fingerprint")
    near = near_links(by_fp.select("fp"), radius)
    end = lambda name: by_fp.select(F.col("fp").alias(name), F.col("first").alias(f"{name}_set"))
    proposed = near.join(end("u"), "u").join(end("v"), "v").select(F.col("u_set").alias("u"), F.col("v_set").alias("v"))
    mixed = marked.join(by_fp.where("first <> last"), "fp").select(F.col("node").alias("u"), F.col("first").alias("v"))
    proposed = proposed.unionByName(mixed).where("u <> v")

    held = []

    def bodies(nodes: DataFrame) -> DataFrame:
        wanted = stage(reps.join(nodes, "node").select(F.col("rep").alias("w")).distinct(), "wanted")
        held.append(wanted)
        bits = bits_for(wanted.count())
        # Few texts are wanted: the filter keeps the others out of the shuffle.
        likely = may_hold(texts, F.col("id"), key_bits(wanted, "w", bits), bits)
        # An inner join: a semi join would be moved below the filter's join, and all texts be shuffled.
        read = likely.join(wanted, F.col("id").eqNullSafe(F.col("w"))).select(whole("text").alias("k")).select("k.*")
        return read.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("body").alias("body"))

    links = minhash.similar_links(reps.select("node", "n", "keys", "sig"), bodies, least, proposed=proposed)
    known = _classes(marked, "node", reps.select("node", "rep", "m"), links)
    discard(*held, by_fp, reps)  # _classes has written what it took from reps; the result reads the nodes and the classes
    return known.select(F.col("id").alias(id_col), "fp", "component_id")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
