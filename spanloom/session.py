"""Sessions, and shipping the package to executors that can't import it."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for one machine, with so much memory for its only JVM; on a cluster the submitter's configuration is used as it is."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("spanloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Give executors this package as a zip, once per application. Only the workers of a local master share the driver's Python path."""
    root = Path(__file__).resolve().parents[1]
    context = spark.sparkContext
    here = re.fullmatch(r"local(\[[^\]]*\])?", context.master) and str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if here or context.applicationId in _shipped:
        return
    folder = os.path.realpath(tempfile.mkdtemp(prefix="spanloom-ship-"))
    context.addPyFile(shutil.make_archive(f"{folder}/spanloom", "zip", root, "spanloom"))
    _shipped.add(context.applicationId)
