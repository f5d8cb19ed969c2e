"""Moving windows by position and by label, truncated averages, gap filling."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from sparkcube.axes import Axis, AxisError, IntervalLabel
from sparkcube.cube import Cube
from sparkcube.functions.nulls import REDUCERS
from sparkcube.operators.select import as_number
from sparkcube.plans.axismap import apply_map

#: Reducers that give the same over axis after axis; mean goes through sum and count.
_SEPARABLE = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}


def shift(cube: Cube, dim: str, offset: int, oob: Any = None) -> Cube:
    """The value `offset` positions on (negative: back). Outside the axis it is oob; missing cells inside stay missing."""
    axis = cube.axis(dim)
    dense = cube.densify()
    over = Window.partitionBy(*cube.others(axis.name)).orderBy(_place(axis))
    moved = F.lead(dense.v, offset, oob) if offset >= 0 else F.lag(dense.v, -offset, oob)
    return dense.rebuild(moved.over(over))


def _place(axis: Axis) -> Column:
    """Order along an axis: by label where labels ascend, else by position."""
    if axis.order() == "forward":
        return F.col(axis.name)
    if axis.order() == "reverse":
        return F.desc(axis.name)
    at = F.create_map(*[F.lit(x) for v, i in axis.index().items() for x in (v, i)])
    return at[F.col(axis.name)]


def offsets(cube: Cube, dim: str, pre: int, after: int, oob: Any = None, name: str = "offset") -> Cube:
    """The window's slices themselves: a new axis of offsets -pre..after."""
    axis = cube.axis(dim)
    dense = cube.densify()
    over = Window.partitionBy(*cube.others(axis.name)).orderBy(_place(axis))
    ks = range(-pre, after + 1)
    wide = dense.df.select(*cube.dims, *[(F.lead(dense.v, k, oob) if k >= 0 else F.lag(dense.v, -k, oob)).over(over).alias(str(k)) for k in ks])
    long = wide.unpivot(list(cube.dims), [str(k) for k in ks], name, cube.value).withColumn(name, F.col(name).cast("long"))
    return cube.with_df(long, [*cube.axes, Axis(name, tuple(ks))])


def _targets(axis: Axis, pre: int, after: int) -> list[tuple[Any, Any, float]]:
    v = axis.values
    return [(v[i + k], v[i], 1.0) for i in range(len(v)) for k in range(-pre, after + 1) if 0 <= i + k < len(v)]


def moving(cube: Cube, how: str | Callable[[Column], Column], **windows: tuple[int, int]) -> Cube:
    """A reduction over a moving window of positions (before, after) along one or several axes; windows end at the axis' ends.

    One axis and a forward order runs as a Window over positions; several axes run one after the other where the reduction allows
    (3 + 3 instead of 9 copies of a cell for a 3 x 3 window), else jointly.
    """
    spans = {cube.axis(q).name: w for q, w in windows.items()}
    if how == "mean":
        # sum and count travel together as a struct, axis after axis
        df = cube.df.select(*cube.dims, F.struct(cube.v.cast("double").alias("s"), cube.v.isNotNull().cast("long").alias("n")).alias(cube.value))
        both = lambda v, w: F.struct(F.sum(v["s"]).alias("s"), F.sum(v["n"]).alias("n"))
        for name, (pre, after) in spans.items():
            axis = cube.axis(name)
            df = apply_map(df, axis, axis, _targets(axis, pre, after), cube.others(name), cube.value, both)
        return cube.with_df(df.select(*cube.dims, (F.col(cube.value)["s"] / F.when(F.col(cube.value)["n"] > 0, F.col(cube.value)["n"])).alias(cube.value)))
    if how not in _SEPARABLE and len(spans) > 1:
        raise AxisError(f"{how!r} over several moving windows: use operators.slices.map_cube with offsets()")
    out = cube
    for i, (name, (pre, after)) in enumerate(spans.items()):
        axis = out.axis(name)
        fold = "sum" if how == "count" and i else how  # counts of counts add up
        agg = REDUCERS[fold] if isinstance(fold, str) else fold
        df = apply_map(out.df, axis, axis, _targets(axis, pre, after), out.others(name), out.value, lambda v, w, agg=agg: agg(v))
        out = out.with_df(df.select(*out.dims, out.value))
    return out


def moving_mean(cube: Cube, dim: str, before: int, after: int) -> Cube:
    """Truncated moving average over dense rows, as a window over ranges of rows: no join, one shuffle by the other axes."""
    axis = cube.axis(dim)
    dense = cube.densify()
    over = Window.partitionBy(*cube.others(axis.name)).orderBy(_place(axis)).rowsBetween(-before, after)
    return dense.rebuild(F.avg(dense.v).over(over))


def intervals(axis: Axis, left: Sequence[Any] | None = None, right: Sequence[Any] | None = None, center: Sequence[Any] | None = None, width: Any = None, closed: str = "right") -> list[IntervalLabel]:
    """Label ranges from two of left, right, center, width; closed says which end belongs (right: open to the left, the default)."""
    if left is not None and right is not None:
        pairs = list(zip(left, right, strict=True))
    elif width is None:
        raise AxisError("intervals need left and right, or a width")
    elif left is not None:
        pairs = [(x, x + width) for x in left]
    elif right is not None:
        pairs = [(x - width, x) for x in right]
    else:
        half = width / 2
        pairs = [(x - half, x + half) for x in (axis.values if center is None else center)]
    return [IntervalLabel(a, b, closed) for a, b in pairs]


def moving_intervals(cube: Cube, dim: str, spans: Sequence[IntervalLabel], how: str | Callable[[Column], Column] = "sum", labels: str = "middle") -> Cube:
    """A reduction over label ranges, which may overlap or leave gaps. The new label is that of the middle covered position
    (labels="middle"), or the range itself (labels="interval")."""
    axis = cube.axis(dim)
    rows, targets = [], []
    for s in spans:
        covered = [i for i, v in enumerate(axis.values) if s.covers(v)]
        if covered:
            to = s if labels == "interval" else axis.values[covered[0] + (covered[-1] - covered[0]) // 2]
            targets.append(to)
            rows += [(axis.values[i], to, 1.0) for i in covered]
    target = Axis(axis.name, tuple(dict.fromkeys(targets)), axis.kind)
    agg = REDUCERS[how] if isinstance(how, str) else how
    df = apply_map(cube.df, axis, target, rows, cube.others(axis.name), cube.value, lambda v, w: agg(v))
    axes = [target if a is axis else a for a in cube.axes]
    return cube.with_df(df.select(*(a.name for a in axes), cube.value), axes)


def whole(cube: Cube, dim: str, how: str = "mean") -> Cube:
    """The whole axis as one window, labelled by the range from its first to its last label."""
    axis = cube.axis(dim)
    return moving_intervals(cube, dim, [IntervalLabel(min(axis.values), max(axis.values), "both")], how, labels="interval")


def fill_gaps(cube: Cube, dim: str, limit_to_inside: bool = False) -> Cube:
    """Missing cells along an axis (numbers, dates or times) by straight lines between valid neighbours; flat beyond the outermost ones, or
    missing there with limit_to_inside."""
    axis = cube.axis(dim)
    dense = cube.densify()
    x = F.col(axis.name)
    at = as_number(x, dense.df.schema[axis.name].dataType)
    w = Window.partitionBy(*cube.others(axis.name)).orderBy(_place(axis))
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    there = F.when(dense.v.isNotNull(), at)
    v0, v1 = F.last(dense.v, True).over(back), F.first(dense.v, True).over(ahead)
    x0, x1 = F.last(there, True).over(back), F.first(there, True).over(ahead)
    line = v0 + (v1 - v0) * (at - x0) / F.when(x1 != x0, x1 - x0)
    filled = F.coalesce(dense.v, line) if limit_to_inside else F.coalesce(dense.v, line, v0, v1)
    return dense.rebuild(filled)
