"""CF conventions: packed values, fill values, and times as numbers since an origin in several calendars."""

from __future__ import annotations

import datetime
import re
from collections.abc import Mapping, Sequence
from typing import Any, NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNIT = {"days": 86_400, "day": 86_400, "hours": 3600, "hour": 3600, "minutes": 60, "minute": 60, "seconds": 1, "second": 1}
_MONTHS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
ORIGIN = "days since 1980-01-01"


class CFDate(NamedTuple):
    """A date of a calendar that the standard library has no type for."""

    year: int
    month: int
    day: int
    second: int = 0


def decode_values(v: Column, attrs: Mapping[str, Any]) -> Column:
    """Scale, offset and missing value, if any of them is given; a fill value alone changes nothing."""
    if not {"missing_value", "scale_factor", "add_offset"} & set(attrs):
        return v
    if "missing_value" in attrs:
        v = F.when(v != F.lit(attrs["missing_value"]), v)
    if "scale_factor" in attrs or "add_offset" in attrs:
        v = v * F.lit(float(attrs.get("scale_factor", 1))) + F.lit(float(attrs.get("add_offset", 0)))
    return v


def _year_days(calendar: str) -> int:
    return {"noleap": 365, "365_day": 365, "all_leap": 366, "366_day": 366, "360_day": 360}[calendar]


def _month_days(calendar: str) -> tuple[int, ...]:
    if calendar == "360_day":
        return (30,) * 12
    return _MONTHS if _year_days(calendar) == 365 else (31, 29, *_MONTHS[2:])


def to_days(date: CFDate, calendar: str) -> int:
    return date.year * _year_days(calendar) + sum(_month_days(calendar)[: date.month - 1]) + date.day - 1


def from_days(days: int, second: int, calendar: str) -> CFDate:
    year, left = divmod(days, _year_days(calendar))
    for month, n in enumerate(_month_days(calendar), 1):
        if left < n:
            return CFDate(year, month, left + 1, second)
        left -= n
    raise AssertionError


def decode_times(values: Sequence[float], units: str, calendar: str = "standard") -> list:
    """Times of "<unit> since <origin>": dates where all fall on midnights, datetimes (whole milliseconds) else; CFDate for other calendars."""
    m = re.match(r"^(\w+) since (\d{1,4})-(\d{1,2})-(\d{1,2})(?:[ T](\d{1,2}):(\d{1,2}):?(\d{1,2})?)?", units)
    if not m or m[1].lower() not in _UNIT:
        raise ValueError(f"not a time unit: {units!r}")
    scale, origin = _UNIT[m[1].lower()], [int(x) if x else 0 for x in m.groups()[1:]]
    seconds = origin[3] * 3600 + origin[4] * 60 + origin[5]
    if calendar in ("standard", "gregorian", "proleptic_gregorian"):
        start = datetime.datetime(*origin[:3]) + datetime.timedelta(seconds=seconds)
        out = [start + datetime.timedelta(milliseconds=round(float(v) * scale * 1000)) for v in values]
        return [x.date() for x in out] if all(x.time() == datetime.time() for x in out) else out
    base = to_days(CFDate(*origin[:3]), calendar) * 86_400 + seconds
    return [from_days(*divmod(base + round(float(v) * scale), 86_400), calendar) for v in values]


def encode_times(values: Sequence[Any], calendar: str = "standard") -> list[float]:
    """Days since 1980-01-01."""
    if values and isinstance(values[0], CFDate):
        base = to_days(CFDate(1980, 1, 1), calendar)
        return [to_days(v, calendar) - base + v.second / 86_400 for v in values]
    start = datetime.datetime(1980, 1, 1)
    full = [v if isinstance(v, datetime.datetime) else datetime.datetime(v.year, v.month, v.day) for v in values]
    return [(v - start).total_seconds() / 86_400 for v in full]
