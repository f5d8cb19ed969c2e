"""Named-axis alignment: the engine's join. Shared axes must have equal labels; cells meet on them, other axes multiply."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcube.axes import Axis, AxisError
from sparkcube.cube import Cube, Dataset


def union_axes(cubes: Sequence[Cube]) -> tuple[Axis, ...]:
    out: dict[str, Axis] = {}
    for c in cubes:
        for a in c.axes:
            if a.name in out and not out[a.name].same_as(a):
                raise AxisError(f"axis {a.name} has different labels in two inputs")
            out.setdefault(a.name, a)
    return tuple(out.values())


def join_cubes(cubes: Sequence[Cube], values: Sequence[str], how: str = "inner") -> DataFrame:
    """One table of all axes and a column for each cube's value. Inner joins suit functions that give missing for missing."""
    out, have = None, set()
    for c, name in zip(cubes, values):
        frame = c.to_df(name)
        if out is None:
            out = frame
        else:
            shared = [d for d in c.dims if d in have]
            # no shared axis: an outer product, which is what the operation means
            out = out.join(frame, shared, how) if shared else out.crossJoin(frame)
        have |= set(c.dims)
    return out


def xmap(fn: Callable[..., Column], *cubes: Cube, value: str = "value", how: str = "inner", props: dict | None = None) -> Cube:
    """fn over the aligned values of any number of cubes. Cubes that are columns of one table under equal axes need no join."""
    axes = union_axes(cubes)
    merged = props if props is not None else {k: v for c in cubes for k, v in c.props.items()}
    names = [f"_v{i}" for i in range(len(cubes))]
    df = join_cubes(cubes, names, how)
    return Cube(df.select(*(a.name for a in axes), fn(*map(F.col, names)).alias(value)), axes, value, merged)


def same_table(fn: Callable[..., Column], df: DataFrame, axes: Sequence[Axis], *values: str, value: str = "value") -> Cube:
    """The same for columns of one table: a projection."""
    return Cube(df.select(*(a.name for a in axes), fn(*map(F.col, values)).alias(value)), tuple(axes), value)


def zip_map(fn: Callable[..., Column], *cubes: Cube) -> Cube:
    """A strict zip: all axes and chunks must be equal; properties are merged, later ones win."""
    first = cubes[0]
    for c in cubes[1:]:
        if set(c.dims) != set(first.dims):
            raise AxisError("zipped cubes need the same axes")
        if c.chunks != first.chunks:
            raise AxisError("zipped cubes need the same chunks")
    return xmap(fn, *cubes)


def cube_table(how: str = "full", **cubes: Cube) -> DataFrame:
    """Cubes as one table, joined on the axes that they share; a row with one variable missing still serves the others."""
    names, frames = list(cubes), list(cubes.values())
    union_axes(frames)
    return join_cubes(frames, names, how)


def dataset_table(ds: Dataset) -> DataFrame:
    return cube_table(**ds.cubes)


def outer(fn: Callable[..., Column], *cubes: Cube, **kwargs: Any) -> Cube:
    """xmap over cubes without shared axes."""
    return xmap(fn, *cubes, **kwargs)
