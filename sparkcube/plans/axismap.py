"""The central primitive: a small table (source label, target label, weight) joined to a cube's axis, then grouped by target.

Selections, label groups, windows, intervals, resampling and weights are such tables. They are built on the driver from the axes'
labels; up to BROADCAST_ROWS they are broadcast, larger ones are joined by shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcube.axes import Axis

BROADCAST_ROWS = 200_000


def stored(label: Any, kind: T.DataType) -> Any:
    """A label as a column of this type holds it: intervals as (left, right), whole numbers as floats in a column of floats."""
    if isinstance(kind, T.StructType):
        return tuple(stored(x, f.dataType) for x, f in zip(label, kind.fields))
    return float(label) if isinstance(kind, (T.DoubleType, T.FloatType)) and label is not None else label


def label_frame(spark: SparkSession, kind: T.DataType, target: T.DataType, rows: Sequence[tuple[Any, Any, float]], source: str, dest: str, weight: str) -> DataFrame:
    schema = T.StructType([T.StructField(source, kind), T.StructField(dest, target), T.StructField(weight, T.DoubleType())])
    frame = spark.createDataFrame([(stored(s, kind), stored(d, target), float(w)) for s, d, w in rows], schema)
    return F.broadcast(frame) if len(rows) <= BROADCAST_ROWS else frame


def type_of(labels: Iterable[Any]) -> T.DataType:
    """Spark type of an axis' labels."""
    import datetime

    labels = list(labels)
    first = next((x for x in labels if x is not None), None)
    if isinstance(first, bool):
        return T.BooleanType()
    if isinstance(first, int) and all(isinstance(x, int) for x in labels):
        return T.LongType()
    if isinstance(first, (int, float)):
        return T.DoubleType()
    if isinstance(first, datetime.datetime):
        return T.TimestampNTZType()
    if isinstance(first, datetime.date):
        return T.DateType()
    if getattr(first, "_fields", ())[:1] == ("year",):  # dates of other calendars
        return T.StructType([T.StructField(n, T.IntegerType()) for n in first._fields])
    if isinstance(first, tuple):
        inner = type_of([x for row in labels for x in row[:2]])
        return T.StructType([T.StructField("left", inner), T.StructField("right", inner)])
    return T.StringType()


def apply_map(
    df: DataFrame, source: Axis, target: Axis, rows: Sequence[tuple[Any, Any, float]], others: Sequence[str], value: str, how: Callable[[Column, Column], Column], target_type: T.DataType | None = None
) -> DataFrame:
    """Cells joined to the map by source label and aggregated per (others, target): how(value, weight)."""
    kind = df.schema[source.name].dataType
    kind_to = target_type or (kind if target.name == source.name and type_of(target.values) == type_of(source.values) else type_of(target.values))
    frame = label_frame(df.sparkSession, kind, kind_to, rows, source.name, "_to", "_w")
    joined = df.select(*others, source.name, value).join(frame, source.name)
    return joined.groupBy(*others, F.col("_to").alias(target.name)).agg(how(F.col(value), F.col("_w")).alias(value))
