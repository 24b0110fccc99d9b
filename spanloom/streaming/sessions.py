"""Chains of nearby events on an unbounded input: the streaming counterpart of loci, where time takes the place of position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, time: str, value: str, gap: str, late: str) -> DataFrame:
    """(key, start, end, n, total): events of a key whose distance is under ``gap`` form one session; end is ``gap`` after the last event.

    On a stream, events later than the watermark ``late`` are left out, and a session is emitted once the watermark has passed its end (append
    mode); on a table the watermark has no effect. State per key is one row per open session.
    """
    windowed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w"))
    return windowed.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")
