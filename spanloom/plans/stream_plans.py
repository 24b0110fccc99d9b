"""The streaming extension on the events table, as a batch query with an oracle; tests run it as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.plans.book import View, query
from spanloom.streaming.sessions import sessions


@query("x1_sessions", """WITH f AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM f)
SELECT user_id, count(*) AS n, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS last_us, round(sum(value), 4) AS total FROM g GROUP BY user_id, k""")
def event_sessions(v: View) -> DataFrame:
    found = sessions(v.table("events"), "user_id", "ts", "value", "2 hours", "1 day")
    micros = lambda c: F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast({c} as timestamp_ntz))")
    return found.select("user_id", "n", micros("start").alias("start_us"), (micros("`end`") - 7_200_000_000).alias("last_us"), F.round("total", 4).alias("total"))
