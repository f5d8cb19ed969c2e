"""Reductions, scans and slice functions over axes."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from sparkcube.axes import Axis
from sparkcube.cube import Cube
from sparkcube.functions.nulls import REDUCERS, SliceFilter, combine, skipping
from sparkcube.functions.nulls import strict as strictly


def _cells(cube: Cube, dims: list[str]) -> int:
    n = 1
    for a in cube.axes:
        n *= len(a) if a.name in dims else 1
    return n


def reduce_cube(cube: Cube, how: str | Callable[[Column], Column], *dims: str, strict: bool = False, filter: SliceFilter | None = None) -> Cube:
    """Aggregates over axes (all, without any given). strict: a missing cell makes the slice missing; else the cells there count.
    filter: slices it skips are missing."""
    over = [cube.axis(d).name for d in dims] or list(cube.dims)
    left = [a for a in cube.axes if a.name not in over]
    out = strictly(how, cube.v, _cells(cube, over)) if strict else skipping(how, cube.v)
    if filter is not None:
        out = F.when(~combine(filter).skip(cube.v, _cells(cube, over)), out)
    df = cube.df.groupBy(*(a.name for a in left)).agg(out.alias(cube.value)) if left else cube.df.agg(out.alias(cube.value))
    return cube.with_df(df, left)


def _along(cube: Cube, dim: str) -> Window:
    from sparkcube.operators.window import _place

    return Window.partitionBy(*cube.others(dim)).orderBy(_place(cube.axis(dim)))


def cumulate(cube: Cube, dim: str, how: str = "sum") -> Cube:
    """Running reduction along an axis, in the order of its positions, whether labels ascend, descend or neither; the axis stays."""
    dim = cube.axis(dim).name
    over = _along(cube, dim).rowsBetween(Window.unboundedPreceding, 0)
    return cube.rebuild(REDUCERS[how](cube.v).over(over))


def normalise(cube: Cube, dim: str, by: str = "max") -> Cube:
    """Values divided by their slice's reduction; the shape stays."""
    from sparkcube.functions.nulls import safe_div

    others = cube.others(cube.axis(dim).name)
    return cube.rebuild(safe_div(cube.v, REDUCERS[by](cube.v).over(Window.partitionBy(*others) if others else Window.partitionBy(F.lit(0)))))


def extrema(cube: Cube, *dims: str, name: str = "Extrema") -> Cube:
    """Minimum and maximum along a new axis with the labels min and max."""
    over = [cube.axis(d).name for d in dims]
    left = [a for a in cube.axes if a.name not in over]
    both = cube.df.groupBy(*(a.name for a in left)).agg(F.min(cube.value).alias("min"), F.max(cube.value).alias("max"))
    df = both.unpivot([a.name for a in left], ["min", "max"], name, cube.value)
    return cube.with_df(df, [Axis(name, ("min", "max")), *left])


def mapslices(fn: str | Callable, cube: Cube, *dims: str, dropdims: bool = True, args: tuple = (), outdims: Any = None, **kwargs: Any) -> Cube:
    """A function of slices: names of reducers and scans run as aggregates and windows, others as Arrow-batched functions of
    numpy arrays (operators.slices), with args and kwargs passed on. dropdims=False keeps reduced axes with a single label.

    What a function's results have for axes is outdims, or else told by its result for a slice of ones: a number has none, an array of
    the slice's shape has the slice's axes, and another one has axes OutAxis1, OutAxis2, ... of positions from 1.
    """
    names = [cube.axis(d).name for d in dims]
    if fn in ("cumsum", "cummax", "cummin", "cumcount"):
        return cumulate(cube, names[0], fn.removeprefix("cum"))
    if fn == "normalise":
        return normalise(cube, names[0], *args)
    if isinstance(fn, str):
        out = reduce_cube(cube, fn, *names, **kwargs)
        if not dropdims:
            axes = [Axis(n, (1,)) for n in names]
            out = out.with_df(out.df.select(*(F.lit(1).alias(n) for n in names), *out.dims, out.value), [*axes, *out.axes])
        return out
    from sparkcube.operators.slices import InDims, OutDims, map_cube

    if outdims is None:
        shape = tuple(len(cube.axis(n)) for n in names)
        made = np.shape(fn(np.ones(shape), *args, **kwargs))
        outdims = OutDims(*(names if made == shape else [Axis(f"OutAxis{i}", range(1, n + 1)) for i, n in enumerate(made, 1)]))
    return map_cube(fn, cube, indims=InDims(*names), outdims=outdims, args=args, kwargs=kwargs)
