"""Zarr version 2 arrays: a Spark data source with one partition per chunk, and a small writer.

Chunks raw or compressed by zlib or gzip, C or Fortran order, fill values, dimension names in _ARRAY_DIMENSIONS.
"""

from __future__ import annotations

import gzip
import itertools
import json
import os
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sparkcube.axes import Axis
from sparkcube.cube import Cube, Dataset
from sparkcube.sources.cf import decode_times, decode_values

#: Attributes that reading uses up.
PACKING = ("missing_value", "scale_factor", "add_offset")
_TYPES = {"b1": T.BooleanType(), "i1": T.ByteType(), "i2": T.ShortType(), "i4": T.IntegerType(), "i8": T.LongType(), "u1": T.ShortType(), "u2": T.IntegerType(), "u4": T.LongType(), "f4": T.FloatType(), "f8": T.DoubleType(), "f2": T.FloatType()}


def _json(path: str) -> dict:
    if not os.path.exists(path):
        return {}
    with open(path) as f:
        return json.load(f)


def _chunk(path: str, meta: dict, at: Sequence[int]) -> np.ndarray | None:
    name = f"{path}/{meta.get('dimension_separator', '.').join(map(str, at))}" if at else f"{path}/0"
    if not os.path.exists(name):
        return None
    with open(name, "rb") as f:
        raw = f.read()
    codec = (meta.get("compressor") or {}).get("id")
    if codec == "zlib":
        raw = zlib.decompress(raw)
    elif codec == "gzip":
        raw = gzip.decompress(raw)
    elif codec is not None:
        raise NotImplementedError(f"compressor {codec}")
    return np.frombuffer(raw, np.dtype(meta["dtype"])).reshape(meta["chunks"], order=meta.get("order", "C"))


def read_array(path: str) -> np.ndarray:
    """A whole array; for axes, which are small."""
    meta = _json(f"{path}/.zarray")
    out = np.full(meta["shape"], meta.get("fill_value") or 0, np.dtype(meta["dtype"]))
    for at in itertools.product(*(range(-(-n // c)) for n, c in zip(meta["shape"], meta["chunks"]))):
        if (chunk := _chunk(path, meta, at)) is not None:
            where = tuple(slice(i * c, min((i + 1) * c, n)) for i, c, n in zip(at, meta["chunks"], meta["shape"]))
            out[where] = chunk[tuple(slice(0, w.stop - w.start) for w in where)]
    return out


@dataclass
class _Chunk(InputPartition):
    at: tuple[int, ...]


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.meta, self.names = path, _json(f"{path}/.zarray"), schema.names

    def partitions(self) -> list[_Chunk]:
        return [_Chunk(at) for at in itertools.product(*(range(-(-n // c)) for n, c in zip(self.meta["shape"], self.meta["chunks"])))]

    def read(self, partition: _Chunk) -> Iterator[pa.RecordBatch]:
        meta = self.meta
        data = _chunk(self.path, meta, partition.at)
        if data is None:  # a chunk that isn't there is all fill value, which is missing
            return
        starts = [i * c for i, c in zip(partition.at, meta["chunks"])]
        data = data[tuple(slice(0, max(0, min(c, n - s))) for c, n, s in zip(meta["chunks"], meta["shape"], starts))]
        fill = meta.get("fill_value")
        flat = data.ravel()
        there = np.ones(len(flat), bool) if fill is None else ~np.isnan(flat) if fill == "NaN" else flat != fill
        where = np.unravel_index(np.flatnonzero(there), data.shape)
        values = flat[there].astype({"u1": np.int16, "u2": np.int32, "u4": np.int64, "f2": np.float32}.get(np.dtype(meta["dtype"]).str[1:], np.dtype(meta["dtype"]).newbyteorder("=")))
        columns = [pa.array(w.astype(np.int64) + s + 1) for w, s in zip(where, starts)]
        for lo in range(0, len(values), 1 << 20):
            yield pa.RecordBatch.from_arrays([*(c.slice(lo, 1 << 20) for c in columns), pa.array(values[lo : lo + (1 << 20)])], names=self.names)


class ZarrSource(DataSource):
    """format("zarr2").load(path of an array): columns i1..in (1-based positions) and value; cells equal to the fill value are absent."""

    @classmethod
    def name(cls) -> str:
        return "zarr2"

    def schema(self) -> T.StructType:
        meta = _json(f"{self.options['path']}/.zarray")
        return T.StructType([*(T.StructField(f"i{k}", T.LongType()) for k in range(1, len(meta["shape"]) + 1)), T.StructField("value", _TYPES[np.dtype(meta["dtype"]).str[1:]])])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema)


def _labels(path: str, name: str, length: int) -> Axis:
    """Labels of a dimension: its coordinate array, decoded if it holds times or named values; else 1..length."""
    folder = f"{path}/{name}"
    if not os.path.exists(f"{folder}/.zarray"):
        return Axis(name, range(1, length + 1))
    attrs, values = _json(f"{folder}/.zattrs"), read_array(folder)
    offset = int(attrs.get("_ARRAY_OFFSET", 0))
    if "_ARRAYVALUES" in attrs:
        return Axis(name, tuple(attrs["_ARRAYVALUES"]), attrs=attrs)
    values = values[offset:].tolist()
    if " since " in str(attrs.get("units", "")):
        try:
            return Axis(name, tuple(decode_times(values, attrs["units"], attrs.get("calendar", "standard"))), attrs=attrs)
        except ValueError:
            pass  # units of another kind: the numbers stand
    return Axis(name, tuple(values), attrs=attrs)


def open_zarr(spark: SparkSession, path: str) -> Dataset:
    """A group as a dataset. Arrays that share a dimension must agree on its length."""
    spark.dataSource.register(ZarrSource)
    arrays = sorted(n for n in os.listdir(path) if os.path.exists(f"{path}/{n}/.zarray"))
    dims = {n: _json(f"{path}/{n}/.zattrs").get("_ARRAY_DIMENSIONS", []) for n in arrays}
    used = {d for n in arrays for d in dims[n]}
    lengths: dict[str, int] = {}
    for n in arrays:
        for d, size in zip(dims[n], _json(f"{path}/{n}/.zarray")["shape"]):
            if lengths.setdefault(d, size) != size:
                raise ValueError(f"dimension {d} has two lengths: {lengths[d]}, {size}")
    axes = {d: _labels(path, d, n) for d, n in lengths.items()}
    cubes = {}
    for n in arrays:
        if n in used or not dims[n]:
            continue
        attrs = _json(f"{path}/{n}/.zattrs")
        df = spark.read.format("zarr2").load(f"{path}/{n}")
        shift = {d: lengths[d] - len(axes[d]) for d in dims[n]}
        columns = []
        for k, d in enumerate(dims[n], 1):
            at = F.col(f"i{k}") - shift[d]
            df = df.where(at >= 1) if shift[d] else df
            columns.append(_label(axes[d], at).alias(d))
        df = df.select(*columns, decode_values(F.col("value"), attrs).alias(n))
        chunks = dict(zip(dims[n], _json(f"{path}/{n}/.zarray")["chunks"]))
        cubes[n] = Cube(df, tuple(axes[d] for d in dims[n]), n, {k: v for k, v in attrs.items() if not k.startswith("_") and k not in PACKING}, chunks)
    return Dataset(cubes, {k: v for k, v in _json(f"{path}/.zattrs").items()})


def _label(axis: Axis, at: Any):
    step, v = axis.step(), axis.values
    if step is not None and isinstance(step, int):
        return (at - 1) * F.lit(step) + F.lit(v[0])
    from sparkcube.plans.axismap import type_of

    return F.element_at(F.array(*[F.lit(x) for x in v]).cast(f"array<{type_of(v).simpleString()}>"), at.cast("int"))


def write_array(path: str, data: np.ndarray, chunks: Sequence[int], dims: Sequence[str], attrs: dict | None = None, fill: Any = None, compress: bool = True) -> None:
    """One array, chunk by chunk; for arrays that fit the driver (axes, fixtures, exports)."""
    os.makedirs(path, exist_ok=True)
    fill = fill if fill is not None else ("NaN" if data.dtype.kind == "f" else None)
    with open(f"{path}/.zarray", "w") as f:
        json.dump({"zarr_format": 2, "shape": list(data.shape), "chunks": list(chunks), "dtype": data.dtype.str, "compressor": {"id": "zlib", "level": 1} if compress else None, "fill_value": fill, "order": "C", "filters": None}, f)
    with open(f"{path}/.zattrs", "w") as f:
        json.dump({"_ARRAY_DIMENSIONS": list(dims), **(attrs or {})}, f)
    for at in itertools.product(*(range(-(-n // c)) for n, c in zip(data.shape, chunks))):
        block = np.full(chunks, np.nan if fill == "NaN" else fill or 0, data.dtype)
        part = data[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunks))]
        block[tuple(slice(0, n) for n in part.shape)] = part
        raw = np.ascontiguousarray(block).tobytes()
        with open(f"{path}/{'.'.join(map(str, at))}", "wb") as f:
            f.write(zlib.compress(raw, 1) if compress else raw)


def _chunk_writer(folder: str, sizes: Sequence[int], kind: str, fill: Any) -> Any:
    n = len(sizes)

    def store(table: pa.Table) -> pa.Table:
        block = np.full(sizes, np.nan if fill == "NaN" else fill, np.dtype(kind))
        block[tuple(table.column(f"o{i}").to_numpy() for i in range(n))] = table.column("v").to_numpy()
        at = ".".join(str(table.column(f"c{i}")[0].as_py()) for i in range(n))
        temporary = f"{folder}/{at}.{os.getpid()}.tmp"
        with open(temporary, "wb") as f:
            f.write(zlib.compress(np.ascontiguousarray(block).tobytes(), 1))
        os.replace(temporary, f"{folder}/{at}")
        return pa.table({"n": pa.array([table.num_rows], pa.int64())})

    return store


def save_zarr(ds: Dataset, path: str, overwrite: bool = False) -> Dataset:
    """A dataset as a Zarr group, one task per chunk; the folder must be mounted on the workers. Variables without chunks get one.

    Missing cells are NaN in floats and the attribute missing_value, or -9999, in whole numbers; chunks without cells aren't
    written. Times are stored as days since 1980-01-01, intervals by their midpoints, other labels by value. Chunk files are put in place
    whole, so a task may run again.
    """
    import datetime
    import shutil

    from sparkcube.axes import IntervalLabel
    from sparkcube.sources.cf import ORIGIN, CFDate, encode_times
    from sparkcube.sources.store import _position

    if os.path.exists(path):
        if not overwrite:
            raise FileExistsError(path)
        shutil.rmtree(path)
    os.makedirs(path)
    with open(f"{path}/.zgroup", "w") as f:
        json.dump({"zarr_format": 2}, f)
    with open(f"{path}/.zattrs", "w") as f:
        json.dump(ds.props, f)
    for a in ds.axes.values():
        v = list(a.values)
        if v and isinstance(v[0], (datetime.date, CFDate)):
            extra, data = {"units": ORIGIN, "calendar": a.attrs.get("calendar", "standard")}, np.array(encode_times(v, a.attrs.get("calendar", "standard")))
        elif v and isinstance(v[0], IntervalLabel):
            extra, data = {}, np.array([x.left + (x.right - x.left) / 2 for x in v], float)
        elif v and isinstance(v[0], str):
            extra, data = {"_ARRAYVALUES": v}, np.arange(1, len(v) + 1)
        else:
            extra, data = {}, np.array(v)
        write_array(f"{path}/{a.name}", data, (max(1, len(v)),), (a.name,), {**{k: x for k, x in a.attrs.items() if k not in extra and not k.startswith("_")}, **extra})
    for name, cube in ds.cubes.items():
        sizes = [int(cube.chunks.get(a.name, max(1, len(a)))) for a in cube.axes]
        kind = {"tinyint": "<i1", "smallint": "<i2", "int": "<i4", "bigint": "<i8", "float": "<f4", "double": "<f8"}[cube.dtype]
        fill = "NaN" if kind[1] == "f" else int(cube.props.get("missing_value", -9999 if kind != "<i1" else -128))
        folder = f"{path}/{name}"
        os.makedirs(folder)
        with open(f"{folder}/.zarray", "w") as f:
            json.dump({"zarr_format": 2, "shape": list(cube.shape), "chunks": sizes, "dtype": kind, "compressor": {"id": "zlib", "level": 1}, "fill_value": fill, "order": "C", "filters": None}, f)
        with open(f"{folder}/.zattrs", "w") as f:
            json.dump({"_ARRAY_DIMENSIONS": list(cube.dims), **cube.props}, f)
        places = [_position(a).cast("long") for a in cube.axes]
        n = len(sizes)
        cells = cube.df.where(cube.v.isNotNull()).select(
            *[F.floor(p / s).alias(f"c{i}") for i, (p, s) in enumerate(zip(places, sizes))], *[(p % s).alias(f"o{i}") for i, (p, s) in enumerate(zip(places, sizes))], cube.v.alias("v")
        )

        store = _chunk_writer(folder, sizes, kind, fill)
        cells.groupBy(*[f"c{i}" for i in range(n)]).applyInArrow(store, "n long").agg(F.sum("n")).collect()
    return open_zarr(next(iter(ds.cubes.values())).df.sparkSession, path)
