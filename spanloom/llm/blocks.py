"""Rows that ask meet the residents of their leaf, in blocks of bounded size, whatever a leaf holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import stage

#: Most residents of a leaf that one block holds, and how many rows to each of these may ask there.
BLOCK, ASKS = 512, 8


def meetings(residents: DataFrame, asked: DataFrame, block: int, own: str, inside: bool) -> DataFrame:
    """residents and asked, of the same columns, among them leaf -> their rows with cell, dealt by (leaf, block) and sorted: of each block
    the residents (cell is even), then those that ask (cell is odd). Every row that asks meets every resident of its leaf.

    Crowded leaves are cut in parts by the hash of the column own, residents and those that ask apart; each part meets each part. With
    inside, residents of different parts of a leaf meet as well.
    """
    both = residents.select("leaf", F.lit(0).alias("asks")).unionByName(asked.select("leaf", F.lit(1).alias("asks")))
    sizes = both.groupBy("leaf").agg(F.sum(1 - F.col("asks")).alias("n"), F.sum("asks").alias("m"))
    cut = lambda c, size: F.least(F.greatest(F.ceil(F.col(c) / size), F.lit(1)), F.lit(1 << 12)).cast("int")
    many = (F.col("n") > block) | ((F.col("m") > ASKS * block) & (F.col("n") > 0))
    crowded = stage(sizes.where(many).select("leaf", cut("n", block).alias("home_parts"), cut("m", ASKS * block).alias("ask_parts")), "crowded-leaves")
    fields = residents.columns
    cell = lambda i, j, asks: (i * (1 << 13) + j * 2 + asks).cast("long").alias("cell")
    n = crowded.count()
    if not n:
        zero = F.lit(0)
        rows = residents.select(*fields, cell(zero, zero, F.lit(0))).unionByName(asked.select(*fields, cell(zero, zero, F.lit(1))))
    else:
        parts = F.broadcast(crowded) if n <= 10_000 else crowded
        mine = lambda c: F.pmod(F.xxhash64(own), F.coalesce(c, F.lit(1))).alias("_own")
        every = lambda c: F.explode(F.sequence(F.lit(0), F.coalesce(c, F.lit(1)) - 1)).alias("_other")
        here, there = residents.join(parts, "leaf", "left"), asked.join(parts, "leaf", "left")
        if inside:
            there = here.where("home_parts > 1").unionByName(there)
        here = here.select(*fields, mine("home_parts"), every("ask_parts")).select(*fields, cell(F.col("_own"), F.col("_other"), F.lit(0)))
        there = there.select(*fields, mine("ask_parts"), every("home_parts")).select(*fields, cell(F.col("_other"), F.col("_own"), F.lit(1)))
        rows = here.unionByName(there)
    return rows.repartition("leaf", F.shiftright("cell", 1)).sortWithinPartitions("leaf", "cell")
