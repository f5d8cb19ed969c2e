"""Resampling onto other labels, axis by axis, through tables of weights."""

from __future__ import annotations

from bisect import bisect_right
from typing import Any

from pyspark.sql import functions as F

from sparkcube.axes import Axis
from sparkcube.cube import Cube
from sparkcube.plans.axismap import apply_map


def _number(x: Any) -> float:
    import datetime

    if isinstance(x, datetime.datetime):
        return (x - datetime.datetime(1970, 1, 1)).total_seconds()
    return float(x.toordinal()) if isinstance(x, datetime.date) else float(x)


def weights(source: Axis, target: Axis, method: str = "linear") -> list[tuple[Any, Any, float]]:
    """(source label, target label, weight). Targets outside the source have none. Nearest: ties go to the smaller label."""
    pairs = sorted((_number(v), v) for v in source.values)
    at = [x for x, _ in pairs]
    rows = []
    for t in target.values:
        x = _number(t)
        if not pairs or x < at[0] or x > at[-1]:
            continue
        k = bisect_right(at, x) - 1
        if at[k] == x:
            rows.append((pairs[k][1], t, 1.0))
        elif method == "nearest":
            rows.append((pairs[k if x - at[k] <= at[k + 1] - x else k + 1][1], t, 1.0))
        else:
            w = (x - at[k]) / (at[k + 1] - at[k])
            rows += [(pairs[k][1], t, 1 - w), (pairs[k + 1][1], t, w)]
    return rows


def resample(cube: Cube, *targets: Axis, method: str = "linear") -> Cube:
    """The cube on new labels along each target's axis; axes that are equal already stay. A target cell is missing where it is
    outside, or where a source cell of non-zero weight is missing."""
    out = cube
    for target in targets:
        axis = out.axis(target.name)
        if len(axis) == len(target) and all(a == b or (isinstance(a, float) and abs(a - b) <= 1e-9 * max(1.0, abs(a))) for a, b in zip(axis.values, target.values)):
            continue
        rows = weights(axis, target, method)
        need: dict[Any, int] = {}
        for _, t, _ in rows:
            need[t] = need.get(t, 0) + 1
        # a target needs as many source cells as its weights name; the count rides along as a fraction of the need
        exact = [(s, t, w) for s, t, w in rows]
        n = F.sum(F.when(F.col(out.value).isNotNull(), F.col("_w")))
        df = apply_map(out.df, axis, target, exact, out.others(axis.name), out.value, lambda v, w, n=n: F.when(F.abs(n - 1) < 1e-9, F.sum(v * w)))
        axes = [target if a is axis else a for a in out.axes]
        out = out.with_df(df.where(F.col(out.value).isNotNull()).select(*(a.name for a in axes), out.value), axes)
    return out
