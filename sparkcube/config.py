"""Defaults of a session's work with cubes."""

from __future__ import annotations

import os
import re

from pyspark.sql import SparkSession

DEFAULTS = {"workdir": ".", "chunksize": "input", "max_cache": float(os.environ.get("SPARKCUBE_MAX_CACHE", "500")) * 1e6}


def parse_bytes(size: float | str) -> float:
    """Bytes of a number, or of a text ending in MB or GB (decimal)."""
    if not isinstance(size, str):
        return float(size)
    m = re.fullmatch(r"\s*([\d.]+)\s*(MB|GB)\s*", size)
    if not m:
        raise ValueError(f"{size!r}: a number followed by MB or GB")
    return float(m[1]) * {"MB": 1e6, "GB": 1e9}[m[2]]


def set_max_cache(spark: SparkSession, size: float | str) -> None:
    """Sizes read partitions and Arrow batches after a memory budget per task."""
    n = parse_bytes(size)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(int(max(n / 4, 1 << 20))))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(int(max(1000, n / 10_000))))
