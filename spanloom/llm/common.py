"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.session import ship
from spanloom.sources.stages import discard, new_path, stage

__all__ = ["WORD", "bits_for", "discard", "fresh", "give_back", "identified", "key_bits", "may_hold", "new_path", "ship", "stage", "table", "word_count"]

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Least and most bits of a filter that is broadcast: 4 KiB to 64 MiB.
FEWEST_BITS, MOST_BITS = 1 << 15, 1 << 29


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores until df has no such column."""
    while name in df.columns:
        name += "_"
    return name


def identified(df: DataFrame, name: str) -> DataFrame:
    """df with a binary in the column name that tells its rows apart, whatever their identifiers are, and is the same at every read. A table
    read from Parquet files gives each row's place: the MD5 of the file's path, and the row's number in it. Other tables are written once
    with numbers."""
    plan = df._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() == "LogicalRelation" and plan.relation().toString() == "parquet" and plan.relation().location().rootPaths().size() == 1:
        file = df.metadataColumn("_metadata")
        return df.withColumn(name, F.unhex(F.concat(F.md5(file["file_path"]), F.lpad(F.hex(file["row_index"]), 16, "0"))))
    return stage(df.withColumn(name, F.unhex(F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0"))), "numbered")


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bits_for(keys: int) -> int:
    """Bits of a filter for so many keys: a power of two, 16 a key or more, within the bounds. Beyond MOST_BITS / 16 keys more rows pass
    than must; results don't change."""
    return min(MOST_BITS, max(FEWEST_BITS, 1 << max(0, 16 * keys - 1).bit_length()))


def _bit(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def key_bits(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """The filter of the keys: a bitmap with one bit a key, in bits / 32768 rows of 4 KiB at most."""
    at = _bit(F.col(key), bits)
    return keys.groupBy(F.bitmap_bucket_number(at).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits"))


def may_hold(rows: DataFrame, key: Column, filter_rows: DataFrame, bits: int, small: bool = True, wanted: bool = True) -> DataFrame:
    """Rows whose key may be in the filter, or with wanted=False all other rows; small: broadcast it (MOST_BITS / 8 bytes at most). Null keys
    count as any other."""
    at = _bit(key, bits)
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    met = rows.withColumn("_bucket", F.bitmap_bucket_number(at)).withColumn("_at", F.bitmap_bit_position(at))
    met = met.join(F.broadcast(filter_rows) if small else filter_rows, "_bucket", "inner" if wanted else "left")
    held = byte.bitwiseAND(F.expr("shiftleft(1, cast(_at % 8 as int))")) != 0
    return met.where(held if wanted else ~F.coalesce(held, F.lit(False))).drop("_bucket", "_at", "_bits")


def give_back(results: Iterator) -> Iterator:
    """The results of a task in a Python worker, after which memory that it has freed goes back to the system: workers live on between tasks,
    and one that has seen large batches would keep their pages while others need them."""
    yield from results
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
