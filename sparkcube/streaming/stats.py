"""Mergeable statistics over streams: the same aggregates as for cubes, kept up by event time."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcube.functions.nulls import REDUCERS


def windowed(events: DataFrame, time: str, window: str, keys: Mapping[str, Column], stats: Mapping[str, tuple[str, str]], late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """A cube over (window start, keys) kept up from a stream (or table): stats by name as (reducer, column); rows later than `late`
    behind the newest are dropped once their window has closed."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    grouped = rows.groupBy(F.window(time, window, slide).alias("w"), *[c.alias(n) for n, c in keys.items()])
    out = grouped.agg(*[REDUCERS[how](F.col(c)).alias(n) for n, (how, c) in stats.items()])
    return out.select(F.col("w.start").alias("start"), *keys, *stats)


def sessions(events: DataFrame, time: str, gap: str, key: str, value: str, late: str = "10 minutes") -> DataFrame:
    """Runs of a key's events less than `gap` apart, with count and sum."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")
