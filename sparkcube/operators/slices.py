"""Functions of slices that built-in expressions can't state, run on numpy arrays in Arrow batches.

Each input is gathered per combination of its loop axes, inputs meet on the loop axes they share, and a batch of slices goes to Python
at once. The slices to skip are found by aggregates before anything leaves the JVM. A slice must fit a worker, nothing else must.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from sparkcube.axes import Axis, AxisError, get_axis
from sparkcube.cube import Cube, Dataset
from sparkcube.functions.nulls import ALL_MISSING, SliceFilter, combine
from sparkcube.operators.align import union_axes
from sparkcube.plans.axismap import type_of


@dataclass(frozen=True)
class InDims:
    """The axes that a function consumes, which slices it skips, and what a slice is turned into (pandas.Series, list; an array by default).

    window has moving windows: (before, after) by axis. Such an axis stays a loop axis, and the slice gets a further axis, after
    the named ones, of the window's positions; those beyond the axis are oob.
    """

    axes: tuple[str, ...]
    filter: SliceFilter = ALL_MISSING
    artype: Callable[[np.ndarray], Any] | None = None
    window: tuple[tuple[str, tuple[int, int]], ...] = ()
    oob: Any = None

    def __init__(self, *axes: str, filter: Any = ALL_MISSING, artype: Callable[[np.ndarray], Any] | None = None, window: Mapping[str, tuple[int, int]] | None = None, oob: Any = None):
        object.__setattr__(self, "axes", axes)
        object.__setattr__(self, "artype", artype)
        object.__setattr__(self, "window", tuple((window or {}).items()))
        object.__setattr__(self, "oob", oob)
        object.__setattr__(self, "filter", combine(filter))


@dataclass(frozen=True)
class OutDims:
    """The axes that a function makes: Axis objects, names of input axes, or none for one number. outtype is a Spark type."""

    axes: tuple[Any, ...]
    outtype: str = "double"

    def __init__(self, *axes: str | Axis, outtype: str = "double"):
        object.__setattr__(self, "axes", axes)
        object.__setattr__(self, "outtype", outtype)


def _index(axis: Axis) -> Column:
    """0-based position of a label: arithmetic on regular axes of numbers, else a look-up."""
    step, v = axis.step(), axis.values
    if isinstance(step, int):
        return ((F.col(axis.name) - F.lit(v[0])) / F.lit(step)).cast("int")
    return F.create_map(*[F.lit(x) for label, i in axis.index().items() for x in (label, i)])[F.col(axis.name)]


def _gather(cube: Cube, inner: list[Axis], name: str, skip: SliceFilter) -> DataFrame:
    """Per combination of loop axes: the positions and values of the cells that are there, and whether the slice is skipped."""
    loop = [d for d in cube.dims if d not in {a.name for a in inner}]
    at, n = F.lit(0), 1
    for a in inner:
        at = at * F.lit(len(a)) + _index(a)
        n *= len(a)
    cells = cube.df.groupBy(*loop) if loop else cube.df.groupBy()
    packed = F.collect_list(F.when(cube.v.isNotNull(), F.struct(at.alias("i"), cube.v.alias("v"))))
    return cells.agg(packed.alias(name), F.coalesce(skip.skip(cube.v, n), F.lit(False)).alias(f"{name}_skip"))


def _windowed(cube: Cube, dims: InDims) -> tuple[Cube, list[str]]:
    """The cube with an axis for each moving window, and the axes that a slice has."""
    from sparkcube.operators.window import offsets

    names = list(dims.axes)
    for query, (pre, after) in dims.window:
        own = cube.axis(query).name
        cube = offsets(cube, own, pre, after, dims.oob, f"{own}_window")
        names.append(f"{own}_window")
    return cube, names


def _slices(column: pa.Array, size: int, numeric: bool) -> np.ndarray:
    """(rows, size) cells from a list column of (position, value): one scatter for all slices of a batch."""
    offsets = column.offsets.to_numpy()
    cells = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    rows = np.repeat(np.arange(len(column)), np.diff(offsets))
    out = np.full((len(column), size), np.nan if numeric else None, float if numeric else object)
    at, values = (cells.field(k) for k in (0, 1))
    if len(cells):
        if numeric and pa.types.is_decimal(values.type):
            values = values.cast(pa.float64())
        out[rows, at.to_numpy(zero_copy_only=False)] = values.to_numpy(zero_copy_only=False)
    return out


def _listed(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column of the rows' cells, NaN and None as nulls."""
    to = np.concatenate([np.zeros(1, np.int32), np.cumsum([len(r) for r in rows], dtype=np.int32)])
    if all(r.dtype.kind in "fiub" for r in rows):
        flat = np.concatenate(rows) if rows else np.zeros(0)
        cells = pa.array(flat, from_pandas=True)
        if not cells.type.equals(kind):
            cells = cells.cast(kind, safe=False)
    else:
        plain = lambda x: None if x is None or (isinstance(x, float) and x != x) else x
        cells = pa.array([plain(x) for r in rows for x in r.tolist()], kind)
    return pa.ListArray.from_arrays(pa.array(to), cells)


def map_cube(
    fn: Callable, *cubes: Cube | Dataset, indims: InDims | Sequence[InDims], outdims: OutDims | Sequence[OutDims] = OutDims(), include_loopvars: bool = False, args: tuple = (), kwargs: Mapping[str, Any] | None = None
) -> Cube | tuple[Cube, ...]:
    """fn(slice, ..., [loop labels], *args, **kwargs) for every combination of loop axes; slices are numpy arrays with NaN (None
    for text) where missing. It returns an array of the output axes' shape, or a tuple of them for several outputs.

    A Dataset is passed as one dict of slices. If any input's filter skips a slice, all outputs are missing there. Output axes come
    first, then the loop axes.
    """
    kwargs = dict(kwargs or {})
    as_dict = None
    if len(cubes) == 1 and isinstance(cubes[0], Dataset):
        as_dict = list(cubes[0].cubes)
        cubes = tuple(cubes[0].cubes.values())
        indims = [indims] * len(cubes) if isinstance(indims, InDims) else indims
    ins = [indims] if isinstance(indims, InDims) else list(indims)
    several = not isinstance(outdims, OutDims)
    outs = list(outdims) if several else [outdims]
    if len(ins) != len(cubes):
        raise AxisError(f"{len(cubes)} inputs, {len(ins)} InDims")
    cubes, wanted = zip(*(_windowed(c, d) for c, d in zip(cubes, ins)))
    union_axes([c for c in cubes])
    inner = [[c.axis(q) for q in names] for c, names in zip(cubes, wanted)]
    loop: dict[str, Axis] = {}
    for c, own in zip(cubes, inner):
        for a in c.axes:
            if a.name not in {x.name for x in own}:
                loop.setdefault(a.name, a)
    known = [a for c in cubes for a in c.axes]
    out_axes = [[a if isinstance(a, Axis) else get_axis({x.name: x for x in known}.values(), a) for a in o.axes] for o in outs]
    joined, have = None, set()
    for i, (c, own, d) in enumerate(zip(cubes, inner, ins)):
        frame = _gather(c, own, f"_in{i}", d.filter)
        names = [x for x in frame.columns if not x.startswith("_in")]
        shared = [x for x in names if x in have]
        joined = frame if joined is None else joined.join(frame, shared) if shared else joined.crossJoin(frame)
        have |= set(names)
    skip = F.lit(False)
    for i in range(len(cubes)):
        skip = skip | F.col(f"_in{i}_skip")
    work = joined.where(~skip).select(*loop, *[f"_in{i}" for i in range(len(cubes))])
    shapes = [tuple(len(a) for a in own) for own in inner]
    numeric = [c.dtype != "string" for c in cubes]
    out_shapes = [tuple(len(a) for a in own) for own in out_axes]
    names, kinds = list(loop), [d.artype for d in ins]

    made = [to_arrow_type(_parse_datatype_string(o.outtype)) for o in outs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            given = [_slices(part.column(len(names) + k), int(np.prod(shape)), num) for k, (shape, num) in enumerate(zip(shapes, numeric))]
            labels = [part.column(k).to_pylist() for k in range(len(names))] if include_loopvars else []
            found: list[list] = [[] for _ in outs]
            for r in range(part.num_rows):
                slices = []
                for k, shape in enumerate(shapes):
                    cells = given[k][r].reshape(shape) if shape else given[k][r][0]
                    slices.append(kinds[k](cells) if kinds[k] else cells)
                asked = [dict(zip(as_dict, slices))] if as_dict else slices
                result = fn(*asked, *([{n: x[r] for n, x in zip(names, labels)}] if include_loopvars else []), *args, **kwargs)
                for k, (x, shape) in enumerate(zip(result if several else [result], out_shapes)):
                    x = np.asarray(x)
                    if x.dtype.kind not in "fiub":
                        x = np.asarray(x, dtype=object)
                    x = x.reshape(-1)
                    if len(x) != int(np.prod(shape)):
                        raise AxisError(f"output {k} has {len(x)} cells, its axes {shape}")
                    found[k].append(x)
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(names))), *(_listed(f, t) for f, t in zip(found, made))], names=[*names, *(f"_out{k}" for k in range(len(outs)))])

    types = "".join(f"`{n}` {joined.schema[n].dataType.simpleString()}, " for n in names)
    result = work.mapInArrow(run, types + ", ".join(f"_out{k} array<{o.outtype}>" for k, o in enumerate(outs)))
    if several:
        result = result.persist()  # the outputs share one pass; spark.catalog.clearCache() or unpersist() of an output's table frees it
    cubes_out = []
    for k, own in enumerate(out_axes):
        cells = result.select(*names, F.posexplode(f"_out{k}").alias("_i", "value"))
        left, columns = F.col("_i"), []
        for a in reversed(own):
            labels = F.array(*[F.lit(x) for x in a.values]).cast(f"array<{type_of(a.values).simpleString()}>")
            columns.insert(0, F.element_at(labels, (left % len(a) + 1).cast("int")).alias(a.name))
            left = F.floor(left / len(a))
        cubes_out.append(Cube(cells.select(*columns, *names, "value").where("value is not null"), (*own, *loop.values())))
    return tuple(cubes_out) if several else cubes_out[0]


def xfunction(fn: Callable, outtype: str = "double") -> Callable[..., Cube]:
    """Makes an element-wise numpy function applicable to aligned cubes, in Arrow batches."""
    from sparkcube.operators.align import xmap

    udf = F.pandas_udf(lambda *columns: pd.Series(fn(*(c.to_numpy() for c in columns))), outtype)
    return lambda *cubes: xmap(udf, *cubes)


def partials(df: DataFrame, keys: Sequence[str], value: str, fit: Callable[[Any, np.ndarray], Any], merge: Callable[[Any, Any], Any], result: Callable[[Any], float]) -> DataFrame:
    """A mergeable statistic of one's own: fit(state or None, values) per batch and key, merge(state, state) across, result(state).
    States are pickled between the two steps; one state per key and batch is shuffled."""
    import pickle

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = [(*(k if isinstance(k, tuple) else (k,)), pickle.dumps(fit(None, g[value].dropna().to_numpy()))) for k, g in part.groupby(list(keys), dropna=True)]
            yield pd.DataFrame(rows, columns=[*keys, "state"])

    def second(part: pd.DataFrame) -> pd.DataFrame:
        state = None
        for raw in part["state"]:
            now = pickle.loads(raw)
            state = now if state is None else merge(state, now)
        return pd.DataFrame([[*(part[k].iloc[0] for k in keys), result(state)]], columns=[*keys, "value"])

    types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, value).mapInPandas(first, f"{types}, state binary").groupBy(*keys).applyInPandas(second, f"{types}, value double")


def pca_dims(cube: Cube, variable: str, over: str, threshold: float = 0.95) -> Cube:
    """Per cell of the other axes: how many principal components of the standardised variables explain more than `threshold`.
    Slices with anything missing have none."""

    def count(x: np.ndarray) -> float:
        if np.isnan(x).any():
            return float("nan")
        sd = x.std(axis=0, ddof=1)
        z = (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1)
        share = np.cumsum(np.linalg.svd(z, compute_uv=False) ** 2)
        return float(np.argmax(share / share[-1] > threshold) + 1)

    return map_cube(count, cube, indims=InDims(over, variable))
