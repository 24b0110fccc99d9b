"""Registered queries, each with its SQL oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanloom.plans import analysis_plans, book, filter_plans, graph_plans, interval_plans, join_plans, stats_plans, stream_plans  # noqa: F401  (the plan modules register their queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(book.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(book.SQL)
