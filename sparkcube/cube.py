"""Handles: a Cube is a long DataFrame (one column per axis, one for the value) with its axes; a Dataset is several cubes by name."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce as _fold
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcube.axes import Axis, AxisError, find_axis, get_axis
from sparkcube.plans.axismap import BROADCAST_ROWS, stored, type_of

_BYTES = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8}
#: Functions (cube, keywords) -> keywords that rewrite selections before they are resolved.
SUBSET_HOOKS: list[Callable[[Any, dict], dict]] = []


@dataclass(frozen=True)
class Cube:
    """Absent rows are missing cells; the axes know the true lengths."""

    df: DataFrame
    axes: tuple[Axis, ...]
    value: str = "value"
    props: dict = field(default_factory=dict)
    chunks: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        missing = [c for c in [*(a.name for a in self.axes), self.value] if c not in self.df.columns]
        if missing:
            raise AxisError(f"the table has no columns {missing}; it has {self.df.columns}")
        if len({a.name for a in self.axes}) < len(self.axes):
            raise AxisError("two axes of one name")
        for name in self.chunks:
            get_axis(self.axes, name)

    @property
    def dims(self) -> tuple[str, ...]:
        return tuple(a.name for a in self.axes)

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(len(a) for a in self.axes)

    @property
    def ndims(self) -> int:
        return len(self.axes)

    @property
    def size(self) -> int:
        return _fold(lambda x, y: x * y, self.shape, 1)

    @property
    def dtype(self) -> str:
        return self.df.schema[self.value].dataType.simpleString()

    def cubesize(self) -> int:
        """Bytes of the dense array."""
        return _BYTES.get(self.dtype, 8) * self.size

    @property
    def v(self) -> Column:
        return F.col(self.value)

    def name(self) -> str | None:
        return next((self.props[k] for k in ("long_name", "standard_name", "name") if k in self.props), None)

    def label(self) -> str:
        unit = next((self.props[k] for k in ("units", "unit") if k in self.props), None)
        return f"{self.name() or self.value}" + (f" [{unit}]" if unit else "")

    def __getattr__(self, name: str) -> Axis:
        if name.startswith("_"):
            raise AttributeError(name)
        found = find_axis(self.axes, name)
        if found is None:
            raise AttributeError(name)
        return found

    def axis(self, query: str | Axis) -> Axis:
        return get_axis(self.axes, query)

    def others(self, *dims: str) -> list[str]:
        return [d for d in self.dims if d not in dims]

    def with_df(self, df: DataFrame, axes: Sequence[Axis] | None = None, **changes: Any) -> Cube:
        axes = self.axes if axes is None else tuple(axes)
        chunks = {k: n for k, n in self.chunks.items() if k in {a.name for a in axes}}
        return replace(self, df=df, axes=tuple(axes), chunks=changes.pop("chunks", chunks), **changes)

    def to_df(self, value: str | None = None) -> DataFrame:
        return self.df.select(*self.dims, self.v.alias(value or self.value))

    def sel(self, **by: Any) -> Cube:
        from sparkcube.operators.select import select

        return select(self, **by)

    def isel(self, **by: Any) -> Cube:
        from sparkcube.operators.select import select_positions

        return select_positions(self, **by)

    def rename(self, names: Mapping[str, str | Axis]) -> Cube:
        """old name to new name, or to an axis of the same length, whose labels take the place of the old ones."""
        out = self
        for query, new in names.items():
            old = out.axis(query)
            if isinstance(new, str):
                axes = tuple(a.renamed(new) if a is old else a for a in out.axes)
                out = out.with_df(out.df.withColumnRenamed(old.name, new), axes)
                continue
            if len(new) != len(old):
                raise AxisError(f"axis {old.name} has {len(old)} labels, the new one {len(new)}")
            source, target = out.df.schema[old.name].dataType, type_of(new.values)
            schema = T.StructType([T.StructField(old.name, source), T.StructField("_new", target)])
            pairs = out.df.sparkSession.createDataFrame([(stored(x, source), stored(y, target)) for x, y in zip(old.values, new.values)], schema)
            joined = out.df.join(F.broadcast(pairs) if len(new) <= BROADCAST_ROWS else pairs, old.name)
            kept = [F.col("_new").alias(new.name) if d == old.name else F.col(d) for d in out.dims]
            out = out.with_df(joined.select(*kept, out.value), [new if a is old else a for a in out.axes])
        return out

    def permute(self, *order: str) -> Cube:
        axes = [self.axis(q) for q in order]
        if {a.name for a in axes} != set(self.dims):
            raise AxisError(f"permute needs all of {self.dims}")
        return self.with_df(self.df.select(*(a.name for a in axes), self.value), axes)

    def dropdims(self, *dims: str) -> Cube:
        gone = [self.axis(d) for d in dims]
        for a in gone:
            if len(a) != 1:
                raise AxisError(f"axis {a.name} has {len(a)} labels, not one")
        return self.with_df(self.df.drop(*(a.name for a in gone)), [a for a in self.axes if a not in gone])

    def rebuild(self, value: Column, props: dict | None = None) -> Cube:
        """The same axes with new values, given as an expression of the columns."""
        return self.with_df(self.df.select(*self.dims, value.alias(self.value)), props=self.props if props is None else props)

    def map(self, fn: Callable[[Column], Column]) -> Cube:
        return self.rebuild(fn(self.v))

    def cast(self, to: str) -> Cube:
        return self.map(lambda v: v.cast(to))

    def replace(self, old: Any, new: Any = None) -> Cube:
        """Cells equal to old get new (missing by default)."""
        return self.map(lambda v: F.when(v.eqNullSafe(F.lit(old)), F.lit(new)).otherwise(v))

    def update(self, where: Column, value: Any) -> Cube:
        """Cells that meet a condition on axes or value get a new value."""
        return self.map(lambda v: F.when(where, value if isinstance(value, Column) else F.lit(value)).otherwise(v))

    def densify(self) -> Cube:
        """A row for every cell, null where it was absent."""
        grid = None
        for a in self.axes:
            t = self.df.schema[a.name].dataType
            frame = self.df.sparkSession.createDataFrame([(stored(x, t),) for x in a.values], T.StructType([T.StructField(a.name, t)]))
            grid = frame if grid is None else grid.crossJoin(F.broadcast(frame) if len(a) <= BROADCAST_ROWS else frame)
        return self.with_df(self.df if grid is None else grid.join(self.to_df(), list(self.dims), "left"))

    def _zip(self, other: Any, fn: Callable[[Column, Column], Column]) -> Cube:
        from sparkcube.operators.align import xmap

        return xmap(fn, self, other) if isinstance(other, Cube) else self.map(lambda v: fn(v, F.lit(other)))

    def __add__(self, other: Any) -> Cube:
        return self._zip(other, lambda a, b: a + b)

    def __sub__(self, other: Any) -> Cube:
        return self._zip(other, lambda a, b: a - b)

    def __mul__(self, other: Any) -> Cube:
        return self._zip(other, lambda a, b: a * b)

    def __truediv__(self, other: Any) -> Cube:
        from sparkcube.functions.nulls import safe_div

        return self._zip(other, safe_div)

    def __pow__(self, other: Any) -> Cube:
        return self._zip(other, lambda a, b: F.pow(a, b))

    def __radd__(self, other: Any) -> Cube:
        return self + other

    def __rmul__(self, other: Any) -> Cube:
        return self * other

    def __rsub__(self, other: Any) -> Cube:
        return self.map(lambda v: F.lit(other) - v)

    def __neg__(self) -> Cube:
        return self.map(lambda v: -v)

    def __invert__(self) -> Cube:
        return self.map(lambda v: ~v)

    def __gt__(self, other: Any) -> Cube:
        return self._zip(other, lambda a, b: a > b)

    def __ge__(self, other: Any) -> Cube:
        return self._zip(other, lambda a, b: a >= b)

    def __lt__(self, other: Any) -> Cube:
        return self._zip(other, lambda a, b: a < b)

    def __le__(self, other: Any) -> Cube:
        return self._zip(other, lambda a, b: a <= b)

    def reduce(self, how: Any, *dims: str, strict: bool = False, filter: Any = None) -> Cube:
        from sparkcube.operators.reduce import reduce_cube

        return reduce_cube(self, how, *dims, strict=strict, filter=filter)

    def cache(self) -> Cube:
        return self.compute()

    def compute(self) -> Cube:
        """Held in memory, spilling to disk."""
        return self.with_df(self.df.persist())

    def to_numpy(self) -> np.ndarray:
        """Dense array in axis order, NaN (None for other types than numbers) where missing. For cubes that fit the driver."""
        numeric = self.dtype in _BYTES and self.dtype != "boolean"
        out = np.full(self.shape, np.nan if numeric else None, float if numeric else object)
        kinds = [self.df.schema[a.name].dataType for a in self.axes]
        index = [{stored(v, k): i for i, v in enumerate(a.values)} for a, k in zip(self.axes, kinds)]
        for row in self.to_df().collect():
            if row[-1] is not None:
                out[tuple(i[tuple(x) if isinstance(x, T.Row) else x] for i, x in zip(index, row[:-1]))] = row[-1]
        return out

    def __repr__(self) -> str:
        return f"Cube {self.label()} ({' x '.join(f'{d}: {n}' for d, n in zip(self.dims, self.shape))}) {self.dtype}, {format_bytes(self.cubesize())}"


def format_bytes(n: float) -> str:
    for unit in ("bytes", "KB", "MB", "GB", "TB"):
        if n < 1024 or unit == "TB":
            return f"{n:.2f} {unit}" if unit != "bytes" else f"{n} bytes"
        n /= 1024
    return ""


def from_array(spark: SparkSession, array: Any, axes: Sequence[Axis] | None = None, props: dict | None = None, value: str = "value") -> Cube:
    """A cube from a numpy array (masked, None or NaN-free entries as they are; None and masked are missing). Default axes: Dim_i = 1..n."""
    data = np.ma.asarray(array, dtype=None) if not isinstance(array, np.ma.MaskedArray) else array
    axes = tuple(axes) if axes is not None else tuple(Axis(f"Dim_{i}", range(1, n + 1)) for i, n in enumerate(data.shape, 1))
    if len(axes) != data.ndim or any(len(a) != n for a, n in zip(axes, data.shape)):
        raise AxisError(f"an array of shape {data.shape} doesn't fit axes of lengths {[len(a) for a in axes]}")
    flat, mask = np.asarray(data.data, dtype=object).ravel(), np.ma.getmaskarray(data).ravel()
    rows = []
    for i, (x, m) in enumerate(zip(flat, mask)):
        if not m and x is not None:
            at = np.unravel_index(i, data.shape)
            rows.append((*(a.values[k] for a, k in zip(axes, at)), x.item() if isinstance(x, np.generic) else x))
    schema = T.StructType([*(T.StructField(a.name, type_of(a.values)) for a in axes), T.StructField(value, type_of([r[-1] for r in rows]))])
    rows = [tuple(stored(x, f.dataType) for x, f in zip(r, schema.fields)) for r in rows]
    return Cube(spark.createDataFrame(rows, schema), axes, value, dict(props or {}))


def from_axis(spark: SparkSession, axis: Axis, value: str = "value") -> Cube:
    """The axis' labels as values along itself."""
    t = type_of(axis.values)
    rows = [(stored(x, t), stored(x, t)) for x in axis.values]
    return Cube(spark.createDataFrame(rows, T.StructType([T.StructField(axis.name, t), T.StructField(value, t)])), (axis,), value)


def from_table(df: DataFrame, dims: Sequence[str], value: str, axes: Mapping[str, Axis] | None = None, props: dict | None = None) -> Cube:
    """A cube over columns of a table. Labels of axes not given are read, sorted, when first asked for."""
    given = dict(axes or {})

    def labels(d: str) -> Callable[[], list]:
        return lambda: [r[0] for r in df.select(d).where(F.col(d).isNotNull()).distinct().orderBy(d).collect()]

    return Cube(df.select(*dims, value), tuple(given.get(d) or Axis(d, labels(d)) for d in dims), value, dict(props or {}))


@dataclass(frozen=True)
class Dataset:
    """Cubes by name, with the union of their axes and global attributes."""

    cubes: dict[str, Cube]
    props: dict = field(default_factory=dict)

    @property
    def axes(self) -> dict[str, Axis]:
        return {a.name: a for c in self.cubes.values() for a in c.axes}

    def __getattr__(self, name: str) -> Cube | Axis:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in self.cubes:
            return self.cubes[name]
        found = find_axis(self.axes.values(), name)
        if found is None:
            raise AttributeError(name)
        return found

    def __getitem__(self, key: str | Sequence[str]) -> Cube | Dataset:
        """One name: that cube, by unique prefix if need be. Several: a dataset; prefixes are renamed to what was asked for."""
        if isinstance(key, str):
            return self.cubes[self._match(key)]
        return Dataset({k: self.cubes[self._match(k)] for k in key}, self.props)

    def _match(self, query: str) -> str:
        if query in self.cubes:
            return query
        found = [n for n in self.cubes if n.startswith(query)]
        if len(found) != 1:
            raise KeyError(f"{query!r} matches {found or 'no variable'}")
        return found[0]

    def sel(self, **by: Any) -> Dataset | Cube:
        """Each cube is narrowed along the axes that it has. With one cube, every axis must be found."""
        from sparkcube.operators.select import select

        variables = by.pop("variables", by.pop("Variables", None))
        target = self if variables is None else self[variables]
        if isinstance(target, Cube):
            return select(target, **by)
        only = len(target.cubes) == 1
        out = {}
        for name, c in target.cubes.items():
            own = {k: s for k, s in by.items() if only or find_axis(c.axes, k) is not None}
            out[name] = select(c, **own)
        return Dataset(out, target.props)

    def map(self, fn: Callable[[Cube], Cube]) -> Dataset:
        return Dataset({k: fn(c) for k, c in self.cubes.items()}, self.props)

    def grouped(self) -> dict[tuple[str, ...], DataFrame]:
        """Wide tables, one per set of axes: variables of equal axes are columns of one table."""
        by: dict[tuple[str, ...], list[str]] = {}
        for n, c in self.cubes.items():
            by.setdefault(tuple(sorted(c.dims)), []).append(n)
        out = {}
        for dims, names in by.items():
            frames = [self.cubes[n].to_df(n) for n in names]
            out[dims] = _fold(lambda x, y, dims=dims: x.join(y, list(dims), "full"), frames)
        return out

    def __repr__(self) -> str:
        return "Dataset\n" + "\n".join(f"  {k}: {c!r}" for k, c in self.cubes.items())


def wide_dataset(df: DataFrame, dims: Sequence[str], variables: Sequence[str], axes: Mapping[str, Axis] | None = None, props: dict | None = None) -> Dataset:
    """Variables as columns of one table: arithmetic between them needs no join (see operators.align.same_table)."""
    first = from_table(df, dims, variables[0], axes)
    return Dataset({v: Cube(df.select(*dims, v), first.axes, v) for v in variables}, dict(props or {}))
