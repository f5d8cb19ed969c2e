"""A cube store on Parquet: a folder of fact tables, one per variable, with a manifest of axes, attributes and chunks.

Only present cells are stored; axes carry the true lengths. Times and intervals keep their types. Appending adds variables in folders of
their own; nothing is edited in place.
"""

from __future__ import annotations

import datetime
import json
import os
import re
import uuid
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sparkcube.axes import Axis, AxisError, AxisKind, IntervalLabel
from sparkcube.cube import Cube, Dataset
from sparkcube.operators.combine import cat, concatenate, merge_datasets, to_cube, to_dataset
from sparkcube.sources.cf import CFDate

MANIFEST = "cube.json"


def _encode(x: Any) -> Any:
    if isinstance(x, datetime.datetime):
        return {"t": x.isoformat()}
    if isinstance(x, datetime.date):
        return {"d": x.isoformat()}
    if isinstance(x, IntervalLabel):
        return {"i": [_encode(x.left), _encode(x.right), x.closed]}
    if isinstance(x, CFDate):
        return {"c": list(x)}
    return x


def _decode(x: Any) -> Any:
    if not isinstance(x, dict):
        return x
    (k, v), = x.items()
    if k == "t":
        return datetime.datetime.fromisoformat(v)
    if k == "d":
        return datetime.date.fromisoformat(v)
    return IntervalLabel(_decode(v[0]), _decode(v[1]), v[2]) if k == "i" else CFDate(*v)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, jvm


def exists(spark: SparkSession, path: str) -> bool:
    fs, at, _ = _fs(spark, path)
    return fs.exists(at)


def _read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, at, _ = _fs(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def save_dataset(ds: Dataset, path: str, overwrite: bool = False, append: bool = False, skeleton: bool = False, compression: str = "snappy") -> Dataset:
    """Writes a dataset and opens it again. An existing store is an error unless it is to be overwritten or appended to; skeleton
    writes axes and attributes only, all cells missing. A variable with chunks is laid out by chunk. What was read from a store that is
    overwritten must be opened again."""
    spark = next(iter(ds.cubes.values())).df.sparkSession
    there = exists(spark, f"{path}/{MANIFEST}")
    if there and not (overwrite or append):
        raise FileExistsError(f"{path} exists: overwrite or append")
    manifest: dict = {"axes": {}, "variables": {}, "attrs": {}}
    if there and append:
        manifest = json.loads(_read_text(spark, f"{path}/{MANIFEST}"))
    for n, c in ds.cubes.items():
        if n in manifest["variables"]:
            raise ValueError(f"variable {n} is there already")
        for a in c.axes:
            labels = [_encode(x) for x in a.values]
            old = manifest["axes"].get(a.name)
            if old is not None and old["values"] != labels:
                raise AxisError(f"axis {a.name} has {len(old['values'])} labels in the store, {len(a)} other ones here")
            manifest["axes"][a.name] = {"values": labels, "kind": a.family.value, "attrs": a.attrs}
    for n, c in ds.cubes.items():
        folder = re.sub(r"\W", "_", n) + f"-{uuid.uuid4().hex[:12]}"
        frame = c.to_df(n)
        if skeleton:
            frame = frame.limit(0)
        else:
            frame = frame.where(F.col(n).isNotNull())
        if c.chunks and not skeleton:
            parts = [F.floor(_position(c.axis(d)) / size) for d, size in c.chunks.items()]
            frame = frame.repartition(*parts).sortWithinPartitions(*c.dims)
        frame.write.option("compression", compression).mode("overwrite").parquet(f"{path}/{folder}")
        manifest["variables"][n] = {"folder": folder, "dims": list(c.dims), "props": c.props, "chunks": c.chunks}
    manifest["attrs"] |= ds.props
    # the cells are in folders of their own until the manifest names them: a store may be overwritten by what is read from it, and a
    # write that fails leaves the old one
    old = json.loads(_read_text(spark, f"{path}/{MANIFEST}"))["variables"] if there and not append else {}
    _write_text(spark, f"{path}/{MANIFEST}", json.dumps(manifest))
    for v in old.values():
        fs, at, _ = _fs(spark, f"{path}/{v['folder']}")
        fs.delete(at, True)
    return open_dataset(spark, path)


def _position(axis: Axis):
    """0-based position of a label as an expression."""
    step = axis.step()
    if isinstance(step, int):
        return (F.col(axis.name) - F.lit(axis.values[0])) / F.lit(step)
    return F.create_map(*[F.lit(x) for v, i in axis.index().items() for x in (v, i)])[F.col(axis.name)]


def _open_store(spark: SparkSession, path: str) -> Dataset:
    m = json.loads(_read_text(spark, f"{path}/{MANIFEST}"))
    axes = {n: Axis(n, tuple(_decode(x) for x in a["values"]), AxisKind(a["kind"]), a["attrs"]) for n, a in m["axes"].items()}
    out = {n: Cube(spark.read.parquet(f"{path}/{v['folder']}"), tuple(axes[d] for d in v["dims"]), n, v["props"], v["chunks"]) for n, v in m["variables"].items()}
    return Dataset(out, m["attrs"])


def _open_zarr(spark: SparkSession, path: str) -> Dataset:
    from sparkcube.sources.zarr import open_zarr

    return open_zarr(spark, path)


#: By file extension or driver name; users add their own.
DRIVERS: dict[str, Callable[[SparkSession, str], Dataset]] = {"cube": _open_store, "zarr": _open_zarr}
_EXTENSIONS = {".zarr": "zarr", ".nc": "netcdf", ".nc4": "netcdf", ".tif": "gdal", ".tiff": "gdal", ".grib": "gdal"}


def open_dataset(spark: SparkSession, path: str, driver: str = "all", skip_keys: Sequence[str] = ()) -> Dataset:
    """A store as a dataset: all variables but skip_keys and those whose names hold "bnds" or "bounds"; none left is an error."""
    if driver == "all":
        driver = _EXTENSIONS.get(os.path.splitext(path.rstrip("/"))[1].lower(), "cube")
    if driver not in DRIVERS:
        raise NotImplementedError(f"{path}: no driver {driver!r}; there are {sorted(DRIVERS)}, and readers of one's own can be added to DRIVERS")
    ds = DRIVERS[driver](spark, path)
    kept = {n: c for n, c in ds.cubes.items() if n not in skip_keys and not re.search("bnds|bounds", n, re.I) and n not in ds.axes}
    if not kept:
        raise ValueError(f"{path} has no variables")
    return Dataset(kept, ds.props)


def _matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob, on any file system that Spark can reach."""
    fs, at, _ = _fs(spark, pattern)
    return sorted(s.getPath().toString() for s in fs.globStatus(at) or [])


def open_mf_dataset(spark: SparkSession, paths: str | Sequence[str]) -> Dataset:
    """Several stores (a glob or a list) merged along the axis by which they differ."""
    found = _matching(spark, paths) if isinstance(paths, str) else list(paths)
    if not found:
        raise FileNotFoundError(str(paths))
    return merge_datasets([open_dataset(spark, p) for p in found])


def open_mf_along(spark: SparkSession, files: Mapping[Any, str | None], dim: str) -> Dataset:
    """Stores by label along a dimension: one that they have is joined in the order given; else it becomes a new last axis with the
    mapping's keys. Labels without a file (None) are missing along a new axis."""
    opened = {k: open_dataset(spark, p) for k, p in files.items() if p is not None}
    first = next(iter(opened.values()))
    out = {}
    for n, c in first.cubes.items():
        parts = {k: d.cubes[n] for k, d in opened.items()}
        if dim in c.dims:
            if len(opened) < len(files):
                raise AxisError(f"a missing file along the existing axis {dim}")
            out[n] = cat(list(parts.values()), dim)
        else:
            joined = concatenate(list(parts.values()), Axis(dim, tuple(parts)), check_chunks=False)
            out[n] = joined.with_df(joined.df, [*joined.axes[:-1], Axis(dim, tuple(files))])
    return Dataset(out, first.props)


def save_cube(cube: Cube, path: str, layername: str | None = None, datasetaxis: str = "Variables", **kwargs: Any) -> Cube:
    """A cube as a store: the labels of datasetaxis become variables. Returns it as opened again."""
    if "chunks" in kwargs:
        raise TypeError("set chunks on the cube")
    return to_cube(save_dataset(to_dataset(cube, datasetaxis, layername), path, **kwargs), datasetaxis)


def open_cube(spark: SparkSession, path: str, **kwargs: Any) -> Cube:
    return to_cube(open_dataset(spark, path, **kwargs))
