"""Operator 1: consistent-hash ring with virtual nodes and bounded loads.

The ring has 2**16 cells. A key's place is the top 16 bits of its hash; each shard owns ``vnodes`` cells, and a key belongs to the
first virtual node clockwise. No shard takes more than its capacity. Loads are settled in rounds: all keys that wait at a shard queue in
ring order, the shard takes as many as it still has room for, and the others walk on clockwise to the next shard with room. As whole runs
of neighbouring keys move together, a round only needs the number of keys on each arc: at most ``n_shards * vnodes`` counts, whatever
the size of the table. Ranks within an arc come from per-cell windows plus per-cell offsets, so no task sees a whole shard.
"""

from __future__ import annotations

from bisect import bisect_left

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.common import table

RING_BITS = 16


def virtual_nodes(n_shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(cell, shard), clockwise. A shard's nodes don't depend on how many other shards there are."""
    shift = 64 - RING_BITS
    return sorted((xxhash.xxh64_intdigest(f"shard {s} node {v}") >> shift, s) for s in range(n_shards) for v in range(vnodes))


def capacities(rows: int, n_shards: int, slack: float) -> list[int]:
    """Room per shard. Without slack the counts end at most one apart; with slack s no shard exceeds (1 + s) times the mean, rounded up."""
    if slack > 0:
        return [-int(-rows * (1 + slack) // n_shards)] * n_shards
    return [rows // n_shards + (s < rows % n_shards) for s in range(n_shards)]


def settle(owners: list[int], counts: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Runs (arc, first rank, end rank, shard, first slot). owners and counts are by arc, clockwise; the sum of room holds all keys."""
    room, filled, runs = list(room), [0] * len(room), []
    waiting = [(arc, 0, n, arc) for arc, n in enumerate(counts) if n]
    while waiting:
        left = []
        for arc, lo, hi, at in sorted(waiting):
            shard = owners[at]
            take = min(hi - lo, room[shard])
            if take:
                runs.append((arc, lo, lo + take, shard, filled[shard]))
                room[shard] -= take
                filled[shard] += take
            if lo + take < hi:
                left.append((arc, lo + take, hi, at))
        waiting = []
        for arc, lo, hi, at in left:
            steps = next(k for k in range(1, len(owners) + 1) if room[owners[(at + k) % len(owners)]])
            waiting.append((arc, lo, hi, (at + steps) % len(owners)))
    return runs


def ring_cell(key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - RING_BITS).cast("int")


def _values(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    if not rows:
        names = [c.strip() for c in columns.split(",")]
        return spark.range(0).select(*(F.col("id").alias(c) for c in names))
    return spark.sql(f"SELECT * FROM VALUES {', '.join(str(tuple(r)) for r in rows)} AS t({columns})")


def ring_shards(rows: DataFrame, n_shards: int, key: str = "doc_id", vnodes: int = 64, slack: float = 0.0) -> DataFrame:
    """rows with ``shard`` and ``slot`` (gapless from 0 in each shard) added; columns of these names are replaced, others kept whatever their names.

    Every row is placed once. Repeated keys are neighbours on the ring, so runs of them spill over like any others; null keys hash to one
    place. An empty table gives an empty result. Depends on the keys and on how many rows there are, never on how they are laid out.
    The plan shuffles each row once, by cell (65536 cells, even unless one key repeats; then that cell's window spills to disk).
    """
    spark = rows.sparkSession
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    rows = rows.select(F.struct(*kept).alias("_row"), F.col(key).alias("_key"), ring_cell(F.col(key)).alias("_cell"))
    nodes = virtual_nodes(n_shards, vnodes)
    cells_of = [c for c, _ in nodes]
    # An arc ends at its node's cell; what lies after the last node wraps to the first. Of nodes in one cell, the first has the arc.
    spans = [(bisect_left(cells_of, c), (cells_of[i - 1] + 1) if i else 0, c) for i, c in enumerate(cells_of)]
    spans = [(arc, lo, hi) for arc, lo, hi in spans if lo <= hi] + [(0, cells_of[-1] + 1, (1 << RING_BITS) - 1)]
    # Bounded by the ring: 65536 rows of two integers.
    ring = _values(spark, [x for x in spans if x[1] <= x[2]], "arc, lo, hi").select("arc", F.explode(F.sequence("lo", "hi")).alias("_cell"))
    turn = F.when(F.col("_cell") > cells_of[-1], 0).otherwise(1)  # on arc 0, cells after the last node come before those at the start
    counts = rows.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n")).join(F.broadcast(ring), "_cell")
    per_arc = {r["arc"]: r["n"] for r in counts.groupBy("arc").agg(F.sum("_n").alias("n")).collect()}
    arcs = [per_arc.get(a, 0) for a in range(len(nodes))]
    runs = settle([s for _, s in nodes], arcs, capacities(sum(arcs), n_shards, slack))
    offsets = counts.select("_cell", F.col("arc").alias("_arc"), (F.sum("_n").over(W.partitionBy("arc").orderBy(turn, "_cell")) - F.col("_n")).alias("_offset"))
    placed = _values(spark, runs, "_arc, _lo, _hi, _shard, _base")
    in_cell = F.row_number().over(W.partitionBy("_cell").orderBy(F.xxhash64("_key"), "_key")) - 1
    return (
        rows.withColumn("_rank", in_cell)
        .join(F.broadcast(offsets), "_cell")  # at most 65536 rows
        .withColumn("_rank", F.col("_rank") + F.col("_offset"))
        .join(F.broadcast(placed).alias("p"), "_arc")  # at most arcs + shards * rounds rows
        .where("_rank >= _lo AND _rank < _hi")
        .select("_row.*", F.col("_shard").cast("int").alias("shard"), (F.col("_base") + F.col("_rank") - F.col("_lo")).cast("long").alias("slot"))
    )


def op1_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
    )
    return ring_shards(docs, 16).select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
