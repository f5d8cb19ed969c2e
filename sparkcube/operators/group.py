"""Grouping: by functions of labels, by another cube's values, and of tables; weighted statistics, histograms, covariance."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcube.axes import Axis, AxisError
from sparkcube.cube import Cube
from sparkcube.functions.nulls import REDUCERS, reducer
from sparkcube.plans.axismap import BROADCAST_ROWS, apply_map

SEASONS = ("Dec_Jan_Feb", "Mar_Apr_May", "Jun_Jul_Aug", "Sep_Oct_Nov")


def season(x: Column | str) -> Column:
    """Season of a date, the year's first one starting in December."""
    names = F.array(*[F.lit(s) for s in SEASONS])
    return F.element_at(names, ((F.month(x) % 12) / 3).cast("int") + 1)


def bins(edges: Sequence[float]) -> Callable[[Any], Any]:
    """Label function: the left edge of the half-open bin that holds a label, None outside."""

    def of(x: Any) -> Any:
        found = [e for e in edges[:-1] if e <= x]
        return found[-1] if found and x < edges[-1] else None

    return of


def group_labels(cube: Cube, dim: str, by: Callable[[Any], Any] | Column, how: str | Callable[[Column], Column] = "mean", name: str | None = None) -> Cube:
    """An axis' labels grouped by a Python function of the label (through a map built on the driver) or by an expression of the column."""
    axis = cube.axis(dim)
    name = name or axis.name
    others = [a for a in cube.axes if a is not axis]
    if isinstance(by, Column):
        df = cube.df.groupBy(*(a.name for a in others), by.alias(name)).agg(reducer(how)(cube.v).alias(cube.value))
        spark_labels = cube.df.select(by.alias("g")).where("g is not null").distinct()
        return cube.with_df(df, [*others, Axis(name, lambda: sorted(r[0] for r in spark_labels.collect()))])
    rows = [(v, g, 1.0) for v in axis.values if (g := by(v)) is not None]
    target = Axis(name, tuple(sorted({g for _, g, _ in rows})))
    df = apply_map(cube.df, axis, target, rows, [a.name for a in others], cube.value, lambda v, w: reducer(how)(v))
    return cube.with_df(df, [*others, target])


def weighted_groups(cube: Cube, dim: str, by: Callable[[Any], Any], weight: Callable[[Any], float], name: str | None = None) -> Cube:
    """Sum of value times weight per group, each label's weight divided by its group's total (as for seasons by days in month)."""
    axis = cube.axis(dim)
    name = name or axis.name
    total: dict = {}
    for v in axis.values:
        total[by(v)] = total.get(by(v), 0) + weight(v)
    rows = [(v, by(v), weight(v) / total[by(v)]) for v in axis.values]
    others = [a for a in cube.axes if a is not axis]
    target = Axis(name, tuple(sorted(total)))
    df = apply_map(cube.df, axis, target, rows, [a.name for a in others], cube.value, lambda v, w: F.sum(v * w))
    return cube.with_df(df, [*others, target])


def group_by_cube(cube: Cube, groups: Cube, how: str | Callable[[Column], Column] = "mean", name: str = "group", expected: Sequence[Any] | None = None) -> Cube:
    """Cells grouped by another cube's values, which may have fewer axes. Its axes are reduced. expected: these groups, empty ones
    included (their cells missing); else those that occur."""
    shared = [a.name for a in groups.axes]
    for a in groups.axes:
        if not cube.axis(a.name).same_as(a):
            raise AxisError(f"axis {a.name} has different labels in cube and groups")
    rest = [a for a in cube.axes if a.name not in shared]
    keyed = cube.df.join(groups.to_df("_g"), shared).where(F.col("_g").isNotNull())
    out = keyed.groupBy(F.col("_g").alias(name), *(a.name for a in rest)).agg(reducer(how)(cube.v).alias(cube.value))
    if expected is None:
        labels = groups.df.select(groups.value).where(groups.v.isNotNull()).distinct()
        return cube.with_df(out, [Axis(name, lambda: sorted(r[0] for r in labels.collect())), *rest])
    full = cube.with_df(out, [Axis(name, tuple(expected)), *rest])
    return full.densify()


def table_fit(df: DataFrame, value: str, by: Mapping[str, Column], how: str | Callable[[Column], Column] = "mean", weight: Column | None = None, axes: Mapping[str, Axis] | None = None) -> Cube:
    """A statistic of a table column per key. Rows with a missing value, key or weight are skipped. With a weight: sum(w v) / sum(w)
    for the mean, sum(w v) for the sum. Keys that are axes of a cube give every label of it, missing where nothing falls."""
    axes = dict(axes or {})
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).alias("_v"), *[k.alias(n) for n, k in by.items()], *([] if weight is None else [weight.alias("_w")]))
    for n in [*by, *([] if weight is None else ["_w"])]:
        rows = rows.where(F.col(n).isNotNull())
    if weight is None:
        stat = reducer(how)(F.col("_v"))
    elif how == "mean":
        stat = F.sum(F.col("_v") * F.col("_w")) / F.when(F.sum("_w") != 0, F.sum("_w"))
    elif how == "sum":
        stat = F.sum(F.col("_v") * F.col("_w"))
    else:
        raise ValueError(f"no weighted {how!r}")
    out = rows.groupBy(*by).agg(stat.alias("value"))
    full = tuple(axes.get(n) or Axis(n, lambda n=n: [r[0] for r in rows.select(n).distinct().orderBy(n).collect()]) for n in by)
    cube = Cube(out, full)
    return cube.densify() if axes and set(axes) == set(by) else cube


def fit_cubes(cubes: Mapping[str, Cube], variable: str, by: Sequence[str | Callable[[DataFrame], Column]], how: str | Callable[[Column], Column] = "mean", weight: Callable[[DataFrame], Column] | None = None) -> Cube:
    """A statistic of one of several cubes, joined on the axes that they share, per key.

    Keys: an axis (all its labels stay, missing where nothing falls); a variable, by its values, or, if its properties have `labels`
    (value to label), by those, under the property `name`; or a function of the joined table, as Category1, Category2, ...
    """
    from sparkcube.operators.align import cube_table, union_axes

    table = cube_table(**cubes)
    known = {a.name: a for a in union_axes(list(cubes.values()))}
    keys: dict[str, Column] = {}
    axes: dict[str, Axis] = {}
    for i, k in enumerate(by, 1):
        if callable(k):
            keys[f"Category{i}"] = k(table)
        elif k in known:
            keys[k], axes[k] = F.col(k), known[k]
        else:
            labels = cubes[k].props.get("labels")
            if labels is None:
                keys[k] = F.col(k)
                continue
            name = cubes[k].props.get("name", "Label")
            keys[name] = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])[F.col(k)]
            axes[name] = Axis(name, tuple(labels.values()))
    return table_fit(table, variable, keys, how, weight(table) if weight else None, axes)


def counter(cube: Cube, expected: Sequence[Any] | None = None) -> Cube:
    """How often each value occurs; expected values that don't occur count 0."""
    found = cube.df.where(cube.v.isNotNull()).groupBy(cube.v.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    if expected is None:
        return Cube(found, (Axis("value", lambda: [r[0] for r in found.select("value").orderBy("value").collect()]),), "n")
    out = Cube(found, (Axis("value", tuple(expected)),), "n").densify()
    return out.rebuild(F.coalesce(out.v, F.lit(0)))


def histogram_2d(df: DataFrame, x: Column, y: Column, x_edges: tuple[float, float, float], y_edges: tuple[float, float, float], weight: Column | None = None) -> DataFrame:
    """Weights summed per cell of a regular grid; edges are (from, to, step). Rows with anything missing or outside are skipped."""
    cut = lambda c, e: F.when((c >= e[0]) & (c < e[1]), F.floor((c - e[0]) / e[2]).cast("int"))
    w = F.lit(1.0) if weight is None else weight
    rows = df.select(cut(x, x_edges).alias("xbin"), cut(y, y_edges).alias("ybin"), w.alias("w")).where("xbin is not null and ybin is not null and w is not null")
    return rows.groupBy("xbin", "ybin").agg(F.sum("w").alias("weight"))


def histogram(cube: Cube, bins_: int, *by: str) -> DataFrame:
    """Adaptive histogram (centroids merged as data come, mergeable between partitions): by, Bin 1..bins_, MidPoints, Frequency; zero-padded.
    Bins depend on the order of merging, as for any such sketch."""
    keys = [cube.axis(b).name for b in by]
    h = cube.df.where(cube.v.isNotNull()).groupBy(*keys).agg(F.histogram_numeric(cube.v.cast("double"), F.lit(bins_)).alias("h"))
    padded = h.select(*keys, F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(bins_)), lambda i: F.get("h", i - 1))).alias("i", "b"))
    return padded.select(*keys, (F.col("i") + 1).cast("int").alias("Bin"), F.coalesce(F.col("b.x"), F.lit(0.0)).alias("MidPoints"), F.coalesce(F.col("b.y"), F.lit(0.0)).alias("Frequency"))


def average_shifted_histogram(cube: Cube, bins_: int, points: int, *by: str, smoothing: int = 5) -> DataFrame:
    """The histogram's centroids smoothed by a triangular kernel at evenly spaced points: by, Bin, MidPoints, Frequency (a density)."""
    keys = [cube.axis(b).name for b in by]

    def smooth(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for row in part.itertuples(index=False):
                x, n = np.array([b["x"] for b in row.h], float), np.array([b["y"] for b in row.h], float)
                at = np.linspace(x.min(), x.max(), points)
                width = max((x.max() - x.min()) / max(1, points - 1) * smoothing, 1e-12)
                density = np.maximum(0, 1 - np.abs(at[:, None] - x[None, :]) / width) @ n / (n.sum() * width)
                out.append(pd.DataFrame({**{k: getattr(row, k) for k in keys}, "Bin": np.arange(1, points + 1, dtype=np.int32), "MidPoints": at, "Frequency": density}))
            yield pd.concat(out) if out else pd.DataFrame(columns=[*keys, "Bin", "MidPoints", "Frequency"])

    h = cube.df.where(cube.v.isNotNull()).groupBy(*keys).agg(F.histogram_numeric(cube.v.cast("double"), F.lit(bins_)).alias("h"))
    types = "".join(f"`{k}` {cube.df.schema[k].dataType.simpleString()}, " for k in keys)
    return h.mapInPandas(smooth, types + "Bin int, MidPoints double, Frequency double")


def weighted_histogram(df: DataFrame, value: Column, weight: Column, bins_: int, by: Mapping[str, Column]) -> DataFrame:
    """Bins of equal weight per group: by, Bin, MidPoints (weighted mean in the bin), Frequency (weight in the bin)."""
    rows = df.select(value.cast("double").alias("v"), weight.cast("double").alias("w"), *[c.alias(n) for n, c in by.items()]).where("v is not null and w > 0")
    over = Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    at = F.least(F.lit(bins_), F.ceil(F.sum("w").over(over) / F.sum("w").over(whole) * F.lit(bins_)).cast("int"))
    return rows.withColumn("Bin", at).groupBy(*by, "Bin").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("MidPoints"), F.sum("w").alias("Frequency"))


def covariance(cube: Cube, variable: str, over: str, weight: Column | None = None) -> Cube:
    """Covariance between the labels of an axis, over another axis: axes X and CoX. Weighted (by a column of the table) it is the
    population form, sum(w x y)/sum(w) - mean x mean y; else the sample form.

    The cells of one `over` label come together once; their pairs are made in the row and summed where they are, so a row per pair of
    labels and task is shuffled, and no pair of cells. Pairs with a cell missing don't count.
    """
    axis, rows = cube.axis(variable), cube.axis(over).name
    w = F.lit(1.0) if weight is None else weight
    cells = cube.df.where(cube.v.isNotNull()).groupBy(rows, w.cast("double").alias("_w")).agg(F.sort_array(F.collect_list(F.struct(F.col(axis.name).alias("l"), cube.v.cast("double").alias("x")))).alias("e"))
    first = cells.select("_w", "e", F.posexplode_outer("e").alias("i", "a")).where("a is not null")
    second = first.select("_w", F.col("a.l").alias("_a"), F.col("a.x").alias("_x"), F.slice("e", F.col("i") + 1, F.size("e")).alias("_s"))
    pairs = second.select("_w", "_a", "_x", F.explode_outer("_s").alias("b")).select("_w", "_a", F.col("b.l").alias("_b"), "_x", F.col("b.x").alias("_y"))
    if weight is None:
        value = F.covar_samp("_x", "_y")
    else:
        mean = lambda c: F.sum(F.col("_w") * c) / F.sum("_w")
        value = mean(F.col("_x") * F.col("_y")) - mean(F.col("_x")) * mean(F.col("_y"))
    half = pairs.groupBy("_a", "_b").agg(value.alias("value"))
    turned = F.when(F.col("_a") == F.col("_b"), F.array(F.struct(F.col("_a").alias("X"), F.col("_b").alias("CoX"))))
    both = turned.otherwise(F.array(F.struct(F.col("_a").alias("X"), F.col("_b").alias("CoX")), F.struct(F.col("_b").alias("X"), F.col("_a").alias("CoX"))))
    df = half.select("value", F.explode(both).alias("e")).select("e.X", "e.CoX", "value")
    return Cube(df, (Axis("X", axis.values), Axis("CoX", axis.values)))


def seasonal_cycle(cube: Cube, dim: str, how: str = "mean", unit: str = "month") -> Cube:
    """The mean year: by month, or by day ("day": month * 100 + day)."""
    d = F.col(cube.axis(dim).name)
    return group_labels(cube, dim, F.month(d) if unit == "month" else F.month(d) * 100 + F.dayofmonth(d), how, name=unit)


def fill_from_cycle(cube: Cube, dim: str, how: str = "mean", unit: str = "month") -> Cube:
    """Missing cells take the mean year's value of their month (or day)."""
    axis = cube.axis(dim)
    d = F.col(axis.name)
    dense = cube.densify().df
    key = F.month(d) if unit == "month" else F.month(d) * 100 + F.dayofmonth(d)
    over = Window.partitionBy(*cube.others(axis.name), key)
    return cube.with_df(dense.select(*cube.dims, F.coalesce(cube.v, REDUCERS[how](cube.v).over(over)).alias(cube.value)))


def anomalies(cube: Cube, dim: str, unit: str = "month") -> Cube:
    """Values minus the mean year."""
    d = F.col(cube.axis(dim).name)
    key = F.month(d) if unit == "month" else F.month(d) * 100 + F.dayofmonth(d)
    others = cube.others(cube.axis(dim).name)
    return cube.rebuild(cube.v - F.avg(cube.v).over(Window.partitionBy(*others, key)))


def correlate(a: Cube, b: Cube, *over: str) -> Cube:
    """Pearson correlation of two cubes over axes, per cell of the others."""
    from sparkcube.operators.align import cube_table, union_axes

    axes = union_axes([a, b])
    over = [a.axis(d).name for d in over]
    left = [x for x in axes if x.name not in over]
    df = cube_table("inner", _a=a, _b=b).groupBy(*(x.name for x in left)).agg(F.corr("_a", "_b").alias("value"))
    return Cube(df, tuple(left))


def regress(y: Cube, x: Cube, *over: str) -> DataFrame:
    """Straight lines of y on x over axes: slope, intercept and exp(slope) per cell of the others."""
    from sparkcube.operators.align import cube_table, union_axes

    axes = union_axes([y, x])
    left = [a.name for a in axes if a.name not in [y.axis(d).name for d in over]]
    both = cube_table("inner", _y=y, _x=x)
    return both.groupBy(*left).agg(F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept")).withColumn("q", F.exp("slope"))
