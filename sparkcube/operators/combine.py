"""Concatenation, merging, conversion between cubes and datasets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce as _fold
from typing import Any

from pyspark.sql import functions as F

from sparkcube.axes import Axis, AxisError, find_axis, get_axis
from sparkcube.cube import Cube, Dataset

_WIDER = ["tinyint", "smallint", "int", "bigint", "float", "double"]


def promote(types: Sequence[str]) -> str:
    """The type that holds all of these; numbers widen, anything else must be equal."""
    kinds = list(dict.fromkeys(types))
    if len(kinds) == 1:
        return kinds[0]
    if not all(k in _WIDER for k in kinds):
        raise AxisError(f"no common type for {kinds}")
    return max(kinds, key=_WIDER.index)


def concatenate(cubes: Sequence[Cube] | Mapping[str, Cube], axis: Axis | str, check_chunks: bool = True) -> Cube:
    """Cubes of equal axes and type along a new last axis, one label each; properties are merged."""
    if isinstance(cubes, Mapping):
        axis = Axis(axis if isinstance(axis, str) else axis.name, tuple(cubes))
        cubes = list(cubes.values())
    if isinstance(axis, str) or len(axis) != len(cubes):
        raise AxisError("the new axis needs a label for each cube")
    first = cubes[0]
    for c in cubes[1:]:
        if c.dims != first.dims or not all(a.same_as(b) for a, b in zip(c.axes, first.axes)):
            raise AxisError("concatenated cubes need equal axes")
        if c.dtype != first.dtype:
            raise AxisError(f"concatenated cubes need one type: {first.dtype}, {c.dtype}")
        if check_chunks and c.chunks != first.chunks:
            raise AxisError("concatenated cubes need equal chunks")
    parts = [c.to_df("value").withColumn(axis.name, F.lit(x)) for c, x in zip(cubes, axis.values)]
    props = {k: v for c in cubes for k, v in c.props.items()}
    df = _fold(lambda a, b: a.unionByName(b), parts).select(*first.dims, axis.name, "value")
    return Cube(df, (*first.axes, axis), "value", props, {**first.chunks, axis.name: 1} if first.chunks else {})


def cat(cubes: Sequence[Cube], dim: str) -> Cube:
    """Cubes along an axis that they have, in the order given; labels may not repeat, other axes must be equal."""
    first, labels = cubes[0], []
    for c in cubes:
        own = c.axis(dim)
        for a in c.axes:
            if a is not own and not first.axis(a.name).same_as(a):
                raise AxisError(f"axis {a.name} differs")
        labels += own.values
    if len(set(labels)) < len(labels):
        raise AxisError(f"labels of {dim} repeat")
    name = first.axis(dim).name
    df = _fold(lambda a, b: a.unionByName(b), [c.to_df("value") for c in cubes])
    return Cube(df, tuple(Axis(name, tuple(labels), a.kind) if a.name == name else a for a in first.axes), "value", first.props)


def _merge_axis(name: str, parts: list[Axis]) -> tuple[Axis, list[int] | None]:
    """The merged axis, and the order of the parts along it (None where all are equal)."""
    if all(p.same_as(parts[0]) for p in parts):
        return parts[0], None
    orders = {p.order() for p in parts if len(p) > 1}
    if len(orders) > 1 or "unordered" in orders:
        raise AxisError(f"axis {name}: parts need one direction")
    down = orders == {"reverse"}
    distinct = list({p.values: p for p in parts}.values())
    distinct.sort(key=lambda p: p.values[0], reverse=down)
    for a, b in zip(distinct, distinct[1:]):
        if not (a.values[-1] > b.values[0] if down else a.values[-1] < b.values[0]):
            raise AxisError(f"axis {name}: parts overlap")
    return Axis(name, tuple(x for p in distinct for x in p.values), parts[0].kind), [0] * len(distinct)


def merge_datasets(sets: Sequence[Dataset]) -> Dataset:
    """The variables that all have, one axis split between the datasets: its parts must ascend (or descend) without overlap, in
    whatever order they are given; all other axes must be equal."""
    shared = [v for v in sets[0].cubes if all(v in s.cubes for s in sets)]
    out = {}
    for v in shared:
        cubes = [s.cubes[v] for s in sets]
        axes, blocks = [], 1
        for a in cubes[0].axes:
            merged, order = _merge_axis(a.name, [c.axis(a.name) for c in cubes])
            axes.append(merged)
            blocks *= len(order) if order else 1
        if blocks != len(sets):
            raise AxisError(f"{v}: {len(sets)} datasets don't fill {blocks} blocks; no axis tells them apart")
        if blocks == 1:
            out[v] = cubes[0]
            continue
        df = _fold(lambda a, b: a.unionByName(b), [c.to_df(v) for c in cubes])
        out[v] = Cube(df, tuple(axes), v, {k: x for c in cubes for k, x in c.props.items()})
    return Dataset(out, {k: x for s in sets for k, x in s.props.items()})


def to_dataset(cube: Cube, axis: str = "Variables", layername: str | None = None) -> Dataset:
    """An axis' labels as variables (columns of one table, through a pivot over known labels); without the axis, one layer."""
    found = find_axis(cube.axes, axis)
    if found is None:
        name = layername or cube.props.get("name", "layer")
        return Dataset({name: cube.with_df(cube.to_df(name), value=name)}, cube.props)
    rest = [a for a in cube.axes if a is not found]
    names = [str(x) for x in found.values]
    wide = cube.df.groupBy(*(a.name for a in rest)).pivot(found.name, list(found.values)).agg(F.first(cube.value)).toDF(*(a.name for a in rest), *names)
    return Dataset({n: Cube(wide.select(*(a.name for a in rest), n), tuple(rest), n) for n in names}, cube.props)


def to_cube(ds: Dataset, joinname: str = "Variables", target_type: str | None = None) -> Cube:
    """Variables with all of the dataset's axes along a new last axis, in the type that holds all of them; a single one as it is."""
    dims = set(ds.axes)
    full = {n: c for n, c in ds.cubes.items() if set(c.dims) == dims}
    if len(ds.cubes) == 1:
        return next(iter(ds.cubes.values()))
    kind = target_type or promote([c.dtype for c in full.values()])
    first = next(iter(full.values()))
    wide = Dataset({n: c for n, c in full.items()}).grouped()
    frame = next(iter(wide.values()))
    long = frame.select(*first.dims, *[F.col(n).cast(kind).alias(n) for n in full]).unpivot(list(first.dims), list(full), joinname, "value")
    return Cube(long.where("value is not null"), (*first.axes, Axis(joinname, tuple(full))), "value", {k: v for k, v in ds.props.items() if k != "name"})


def set_chunks(cube: Cube, chunks: Mapping[str, int] | Sequence[int]) -> Cube:
    """Logical chunk lengths by (prefix of an) axis or in axis order. Values don't change; writers lay files out by chunk."""
    if not isinstance(chunks, Mapping):
        chunks = dict(zip(cube.dims, chunks, strict=True))
    return Cube(cube.df, cube.axes, cube.value, cube.props, {**cube.chunks, **{get_axis(cube.axes, k).name: n for k, n in chunks.items()}})


def set_chunks_dataset(ds: Dataset, chunks: Mapping[str, Any]) -> Dataset:
    """By variable (name to chunks), or by axis for all variables that have it."""
    out = {}
    for n, c in ds.cubes.items():
        own = chunks.get(n) if isinstance(chunks.get(n), (Mapping, tuple, list)) else {k: v for k, v in chunks.items() if isinstance(v, int) and find_axis(c.axes, k)}
        out[n] = set_chunks(c, own) if own else c
    return Dataset(out, ds.props)
