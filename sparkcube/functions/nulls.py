"""Missing cells: strict and skipping reducers, slice filters, and arithmetic with IEEE results where SQL raises or gives null.

A missing cell is a null value or an absent row. A slice's true number of cells comes from the axes, so strict rules need no dense rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

REDUCERS: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "median": F.median,
    "count": F.count,
    "any": F.bool_or,
    "all": F.bool_and,
    "first": lambda v: F.first(v, ignorenulls=True),
    "nunique": F.count_distinct,
    "prod": F.product,
}


def reducer(how: str | Callable[[Column], Column]) -> Callable[[Column], Column]:
    if callable(how):
        return how
    if how not in REDUCERS:
        raise ValueError(f"unknown reducer {how!r}; there are {', '.join(REDUCERS)}")
    return REDUCERS[how]


def skipping(how: str | Callable[[Column], Column], v: Column) -> Column:
    """Over the cells that are there."""
    return reducer(how)(v)


def strict(how: str | Callable[[Column], Column], v: Column, cells: int) -> Column:
    """Missing as soon as one of the slice's cells is."""
    return F.when(F.count(v) == F.lit(cells), reducer(how)(v))


@dataclass(frozen=True)
class SliceFilter:
    """Says which slices are left out: a Column over the slice's value v and its number of cells, true where it is skipped."""

    skip: Callable[[Column, int], Column]

    def __or__(self, other: SliceFilter) -> SliceFilter:
        return SliceFilter(lambda v, n: self.skip(v, n) | other.skip(v, n))


NO_FILTER = SliceFilter(lambda v, n: F.lit(False))
ALL_MISSING = SliceFilter(lambda v, n: F.count(v) == 0)
ANY_MISSING = SliceFilter(lambda v, n: F.count(v) < F.lit(n))
#: All cells there and equal.
STD_ZERO = SliceFilter(lambda v, n: (F.min(v) == F.max(v)) & (F.count(v) == F.lit(n)))


def n_valid(least: int) -> SliceFilter:
    """Skips slices with `least` or fewer cells."""
    return SliceFilter(lambda v, n: F.count(v) <= F.lit(least))


def user_filter(predicate: Callable[[Column], Column]) -> SliceFilter:
    """Skips slices for which the aggregate predicate(v) is true."""
    return SliceFilter(lambda v, n: F.coalesce(predicate(v), F.lit(False)))


def any_ocean(*_: object) -> SliceFilter:
    raise NotImplementedError("AnyOcean is declared without a rule")


def combine(filters: object) -> SliceFilter:
    """A filter, or a sequence of which any may skip."""
    if isinstance(filters, SliceFilter):
        return filters
    out = NO_FILTER
    for f in filters:
        out = out | f
    return out


def safe_div(n: Column, d: Column) -> Column:
    """IEEE division of doubles: x/0 is an infinity, 0/0 NaN; missing stays missing."""
    n, d = n.cast("double"), d.cast("double")
    at_zero = F.when((n == 0) | F.isnan(n), F.lit(float("nan"))).when(n > 0, F.lit(float("inf"))).when(n < 0, F.lit(float("-inf")))
    return F.when(d == 0, at_zero).otherwise(n / F.when(d != 0, d))


def safe_ln(x: Column) -> Column:
    """ln with ln(0) = -Infinity and NaN below zero."""
    x = x.cast("double")
    return F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(F.ln(x))


def equal(a: Column, b: Column) -> Column:
    """Equality in which NaN differs from everything, itself included."""
    return (a == b) & ~F.isnan(a.cast("double")) & ~F.isnan(b.cast("double"))


def nan_to_missing(v: Column) -> Column:
    return F.when(~F.isnan(v), v)


def missing_to(v: Column, value: object) -> Column:
    """For cells whose rows exist; densify first to reach absent ones."""
    return F.coalesce(v, F.lit(value))
