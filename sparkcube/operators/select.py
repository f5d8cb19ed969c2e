"""Selection by label or position. Selectors are resolved on the driver's labels and become plain predicates, which reach the scan."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcube.axes import Axis, AxisError, find_axis, get_axis
from sparkcube.cube import SUBSET_HOOKS, Cube
from sparkcube.plans.axismap import BROADCAST_ROWS, stored


@dataclass(frozen=True)
class At:
    """Exactly these labels; with atol, labels within that distance of one number."""

    label: Any
    atol: float | None = None


@dataclass(frozen=True)
class Near:
    label: Any


@dataclass(frozen=True)
class Interval:
    """A range of labels; closed: both, left, right or neither."""

    lo: Any
    hi: Any
    closed: str = "both"


def Between(lo: Any, hi: Any) -> Interval:  # noqa: N802
    return Interval(lo, hi, "both")


@dataclass(frozen=True)
class Touches:
    """Interval labels that overlap a closed range."""

    lo: Any
    hi: Any


@dataclass(frozen=True)
class Contains:
    """Interval labels that hold a point."""

    point: Any


@dataclass(frozen=True)
class Where:
    """Labels that satisfy a Python predicate or, given a Column of the axis alone, that condition; a Column of other columns too masks
    cells and leaves the axis as it is."""

    test: Callable[[Any], bool] | Column


def _literal(x: Any, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        return F.struct(*[_literal(v, f.dataType).alias(f.name) for v, f in zip(x, kind.fields)])
    return F.lit(x).cast(kind) if isinstance(kind, T.NumericType) else F.lit(x)


def _labels_where(axis: Axis, kind: T.DataType, test: Column, spark: SparkSession) -> Axis | None:
    """The axis' labels that meet a condition on it; None if the condition needs other columns."""
    schema = T.StructType([T.StructField("_at", T.IntegerType()), T.StructField(axis.name, kind)])
    labels = spark.createDataFrame([(i, stored(v, kind)) for i, v in enumerate(axis.values)], schema)
    try:
        kept = labels.where(test)
    except AnalysisException:
        return None
    return axis.take(sorted(r[0] for r in kept.select("_at").collect()))  # labels are the driver's


def _resolve(axis: Axis, kind: T.DataType, selector: Any, spark: SparkSession | None = None) -> tuple[Column, Axis | None, Any]:
    """Predicate, remaining axis (None: a single label, dropped), and the label taken."""
    c = F.col(axis.name)
    if isinstance(selector, Near):
        selector = At(axis.nearest(selector.label))
    if isinstance(selector, At):
        if selector.atol is not None:
            found = [i for i, v in enumerate(axis.values) if abs(v - selector.label) <= selector.atol]
            if not found:
                raise AxisError(f"axis {axis.name}: nothing within {selector.atol} of {selector.label}")
            return F.abs(c - F.lit(selector.label)) <= F.lit(selector.atol), axis.take(found), None
        if isinstance(selector.label, (list, range)) or (isinstance(selector.label, tuple) and not hasattr(selector.label, "_fields")):
            at = [axis.position(x) - 1 for x in selector.label]
            return c.isin([_literal(axis.values[i], kind) for i in at]), axis.take(at), None
        axis.position(selector.label)
        return c == _literal(selector.label, kind), None, selector.label
    if isinstance(selector, Interval):
        lo, hi = selector.closed in ("both", "left"), selector.closed in ("both", "right")
        keep = [i for i, v in enumerate(axis.values) if (v >= selector.lo if lo else v > selector.lo) and (v <= selector.hi if hi else v < selector.hi)]
        a, b = (_literal(x, kind) if isinstance(kind, T.StructType) else F.lit(x) for x in (selector.lo, selector.hi))
        return (c >= a if lo else c > a) & (c <= b if hi else c < b), axis.take(keep), None
    if isinstance(selector, Touches):
        keep = [i for i, v in enumerate(axis.values) if v.left <= selector.hi and v.right >= selector.lo]
        return (c["left"] <= F.lit(selector.hi)) & (c["right"] >= F.lit(selector.lo)), axis.take(keep), None
    if isinstance(selector, Contains):
        keep = [i for i, v in enumerate(axis.values) if v.covers(selector.point)]
        if not keep:
            raise AxisError(f"axis {axis.name}: no label holds {selector.point!r}")
        return c["left"].isin([F.lit(axis.values[i].left) for i in keep]), axis.take(keep), None
    if isinstance(selector, Where):
        if isinstance(selector.test, Column):
            left = _labels_where(axis, kind, selector.test, spark)
            return selector.test, axis if left is None else left, None
        keep = [i for i, v in enumerate(axis.values) if selector.test(v)]
        return c.isin([_literal(axis.values[i], kind) for i in keep]), axis.take(keep), None
    raise AxisError(f"not a selector: {selector!r}")


def select(cube: Cube, **by: Any) -> Cube:
    """Selectors by (prefix of an) axis name. A bare label means At, a list At(list), a slice a closed interval of labels, and a
    pair of numbers (from, to) on a time axis all labels of those years."""
    for hook in SUBSET_HOOKS:
        by = hook(cube, by)
    axes, df, gone = list(cube.axes), cube.df, []
    for query, selector in by.items():
        axis = get_axis(axes, query)
        kind = df.schema[axis.name].dataType
        if isinstance(selector, tuple) and not hasattr(selector, "_fields") and len(selector) == 2 and isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) and all(isinstance(x, int) for x in selector):
            keep = [i for i, v in enumerate(axis.values) if selector[0] <= v.year <= selector[1]]
            predicate, left = F.year(axis.name).between(*selector), axis.take(keep)
        else:
            if isinstance(selector, slice):
                selector = Interval(selector.start, selector.stop)
            elif not isinstance(selector, (At, Near, Interval, Touches, Contains, Where)):
                selector = At(selector)
            predicate, left, _ = _resolve(axis, kind, selector, df.sparkSession)
        df = df.where(predicate)
        at = axes.index(axis)
        if left is None:
            gone.append(axis.name)
            axes.pop(at)
        else:
            axes[at] = left
    return cube.with_df(df.drop(*gone), axes)


def select_positions(cube: Cube, **by: int | Sequence[int] | range | slice) -> Cube:
    """1-based positions: a number drops the axis; a list, range, or slice (both ends included) keeps it."""
    labels = {}
    for query, at in by.items():
        axis = get_axis(cube.axes, query)
        n = len(axis)
        if isinstance(at, slice):
            at = range(at.start or 1, (at.stop or n) + 1, at.step or 1)
        for i in [at] if isinstance(at, int) else at:
            if not 1 <= i <= n:
                raise AxisError(f"position {i} is outside axis {axis.name} of length {n}")
        if isinstance(at, int):
            labels[axis.name] = At(axis.values[at - 1])
        elif isinstance(at, range) and at.step == 1 and axis.order() == "forward" and len(at):
            labels[axis.name] = Interval(axis.values[at[0] - 1], axis.values[at[-1] - 1])
        else:
            labels[axis.name] = At([axis.values[i - 1] for i in at])
    return select(cube, **labels)


def where_other(cube: Cube, query: str, other: Cube, test: Callable[[Column], Column]) -> Cube:
    """Labels of an axis for which another cube along it passes a test: a semi-join, which leaves the axis as it is."""
    axis = get_axis(cube.axes, query)
    passing = other.df.where(test(other.v)).select(get_axis(other.axes, axis.name).name)
    return cube.with_df(cube.df.join(passing, axis.name, "left_semi"))


def as_number(c: Column, kind: T.DataType) -> Column:
    """Numbers, dates (days) and times (seconds) as doubles."""
    if isinstance(kind, T.DateType):
        return F.datediff(c, F.lit("1970-01-01").cast("date")).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double") / 1e6
    return c.cast("double")


def _with_nearest(df: DataFrame, column: str, axis: Axis, kind: T.DataType) -> DataFrame:
    """Adds _at_<axis>: the label nearest to a column, by binary search in Arrow batches; of two as near, the smaller one."""
    import numpy as np
    import pandas as pd

    ordered = sorted(axis.values)
    if not ordered:
        raise AxisError(f"axis {axis.name} is empty")
    number = {T.DateType: lambda x: float(x.toordinal() - 719_163)}.get(type(kind), lambda x: x.timestamp() if hasattr(x, "timestamp") else float(x))
    if isinstance(kind, T.TimestampNTZType):
        import datetime

        number = lambda x: (x - datetime.datetime(1970, 1, 1)).total_seconds()
    at = np.array([number(v) for v in ordered])
    middle = (at[1:] + at[:-1]) / 2
    place = F.pandas_udf(lambda x: pd.Series(np.searchsorted(middle, x.to_numpy(), side="left")).where(x.notna().to_numpy()).astype("Int64"), "long")
    schema = T.StructType([T.StructField("_place", T.LongType()), T.StructField(f"_at_{axis.name}", kind)])
    labels = df.sparkSession.createDataFrame(list(enumerate(ordered)), schema)
    labels = F.broadcast(labels) if len(ordered) <= BROADCAST_ROWS else labels
    return df.withColumn("_place", place(as_number(F.col(column), df.schema[column].dataType))).join(labels, "_place").drop("_place")


def extract_points(cube: Cube, points: DataFrame, point_key: str | None = None) -> Cube:
    """Values at scattered points: columns of `points` that match axes are replaced by the nearest labels, the cube is joined to
    them, and the points take the matched axes' place: as axis `point_key` if there is such a column, else as one named a_b whose
    labels join the points' coordinates."""
    matched = [(c, a) for c in points.columns if c != point_key and (a := find_axis(cube.axes, c)) is not None]
    if not matched:
        raise AxisError("no column of the points matches an axis")
    df = points
    for c, axis in matched:
        df = _with_nearest(df, c, axis, cube.df.schema[axis.name].dataType)
    names = [a.name for _, a in matched]
    if point_key is None:
        point_key = "_".join(c for c, _ in matched)
        df = df.withColumn(point_key, F.concat_ws("_", *[F.col(c).cast("string") for c, _ in matched]))
    left = df.select(point_key, *[F.col(f"_at_{n}").alias(n) for n in names])
    rest = [a for a in cube.axes if a.name not in names]
    out = cube.df.join(left, names).select(point_key, *(a.name for a in rest), cube.value)
    axis = Axis(point_key, lambda: [r[0] for r in left.select(point_key).distinct().orderBy(point_key).collect()])
    return Cube(out, (axis, *rest), cube.value, cube.props)
