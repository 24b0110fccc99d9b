"""Cutting lineage: tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_local: dict[str, str] = {}
_owned: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a temporary folder if all runs in one JVM (tests); on a cluster that is an error, as
    each executor would write to a disk of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="spanloom-")
        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
    return f"file://{_local[app]}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path for a table of this application; the driver's JVM deletes the application's tables when it ends."""
    own = f"{shared_dir(spark)}/spanloom/{spark.sparkContext.applicationId}"
    if own not in _owned:
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _owned.add(own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage", compression: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and losing an executor loses nothing."""
    path = new_path(df.sparkSession, name)
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def packed(df: DataFrame, name: str = "stage") -> DataFrame:
    """As stage, in less space for more time: for tables of numbers."""
    return stage(df, name, "zstd")


@contextmanager
def joined_in_place(spark: SparkSession) -> Iterator[None]:
    """What runs here joins tables where they lie if they are dealt by a part of the join's keys; else Spark shuffles both sides by all of them."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def dealt(df: DataFrame, name: str, *by: str, in_place: bool = False) -> DataFrame:
    """As packed, as a table in buckets by columns, as many as shuffles have partitions: what is joined or grouped by them afterwards needs no shuffle.
    in_place: rows of a bucket are in one task already, though Spark can't know it."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = path.rsplit("/", 1)[1].replace("-", "_")
    with joined_in_place(spark):
        (df if in_place else df.repartition(parts, *by)).write.bucketBy(parts, *by).option("path", path).option("compression", "zstd").saveAsTable(table, format="parquet")
    out = spark.table(table)
    out._staged_at = path
    return out


def stage_and_count(df: DataFrame, name: str, *counts: Column) -> tuple[DataFrame, tuple]:
    """As stage, with aggregates of the rows written: they are taken while the table is written, without a job of their own. Null where no row
    was written."""
    seen = Observation()
    out = stage(df.observe(seen, *(c.alias(f"c{k}") for k, c in enumerate(counts))), name)
    found = seen.get
    return out, tuple(found.get(f"c{k}") for k in range(len(counts)))


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stage`` wrote and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
