"""Named axes with coordinate labels, kept on the driver."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from enum import Enum
from typing import Any, NamedTuple


class AxisKind(Enum):
    X = "X"
    Y = "Y"
    Z = "Z"
    TIME = "TIME"
    VARIABLES = "VARIABLES"
    GENERIC = "GENERIC"


_KINDS = {
    AxisKind.Y: ("lat", "latitude", "rlat", "lat_c"),
    AxisKind.X: ("lon", "longitude", "rlon", "lon_c"),
    AxisKind.Z: ("height", "depth"),
    AxisKind.TIME: ("time", "ti"),
    AxisKind.VARIABLES: ("variables", "variable"),
}


class AxisError(ValueError):
    """Axes that don't fit, can't be found, or can't be told apart."""


class IntervalLabel(NamedTuple):
    """A label that covers a range of a coordinate; closed says which ends belong to it."""

    left: Any
    right: Any
    closed: str = "left"

    def covers(self, x: Any) -> bool:
        lo = x >= self.left if self.closed in ("left", "both") else x > self.left
        return lo and (x <= self.right if self.closed in ("right", "both") else x < self.right)


@dataclass(frozen=True, eq=False)
class Axis:
    """A name and its labels. Labels may come from a function, which runs when they are first asked for."""

    name: str
    labels: Sequence[Any] | Callable[[], Sequence[Any]] = ()
    kind: AxisKind | None = None
    attrs: dict = field(default_factory=dict)
    _cache: dict = field(default_factory=dict, repr=False)

    @property
    def values(self) -> tuple:
        if "v" not in self._cache:
            self._cache["v"] = tuple(self.labels() if callable(self.labels) else self.labels)
        return self._cache["v"]

    @property
    def family(self) -> AxisKind:
        if self.kind is not None:
            return self.kind
        return next((k for k, names in _KINDS.items() if self.name.lower() in names), AxisKind.GENERIC)

    def __len__(self) -> int:
        return len(self.values)

    def same_as(self, other: Axis) -> bool:
        return self is other or (self.labels is other.labels and callable(self.labels)) or self.values == other.values

    def index(self) -> dict:
        if "i" not in self._cache:
            self._cache["i"] = {v: i for i, v in enumerate(self.values)}
        return self._cache["i"]

    def position(self, label: Any) -> int:
        """1-based position of a label."""
        try:
            return self.index()[label] + 1
        except KeyError:
            raise AxisError(f"axis {self.name} has no label {label!r}") from None

    def nearest(self, x: Any) -> Any:
        """The label nearest to x; of two as near, the smaller one."""
        ordered = sorted(self.values)
        if not ordered:
            raise AxisError(f"axis {self.name} is empty")
        k = bisect_left(ordered, x)
        return min(ordered[max(0, k - 1) : k + 1], key=lambda v: (abs(v - x), v))

    def order(self) -> str:
        """forward, reverse or unordered, as the labels stand."""
        v = self.values
        try:
            if all(a < b for a, b in zip(v, v[1:])):
                return "forward"
            if all(a > b for a, b in zip(v, v[1:])):
                return "reverse"
        except TypeError:
            pass
        return "unordered"

    def step(self) -> float | int | None:
        """The constant step of a numeric axis, else None: whole numbers exactly, floats within rounding."""
        v = self.values
        if len(v) < 2 or not all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in v):
            return None
        if all(isinstance(x, int) for x in v):
            d = v[1] - v[0]
            return d if d and all(b - a == d for a, b in zip(v, v[1:])) else None
        d = (v[-1] - v[0]) / (len(v) - 1)
        return d if d and all(abs(v[0] + i * d - x) <= 1e-6 * abs(d) for i, x in enumerate(v)) else None

    def take(self, positions: Iterable[int]) -> Axis:
        """The axis of the labels at these 0-based positions, in this order."""
        v = self.values
        return Axis(self.name, tuple(v[i] for i in positions), self.kind, self.attrs)

    def renamed(self, name: str) -> Axis:
        return Axis(name, self.labels, self.kind, self.attrs, self._cache)


def find_axis(axes: Iterable[Axis], query: str | Axis) -> Axis | None:
    """By name: the axis whose name starts with the query, whatever the case ("time" means "Ti..."); by value: the axis of equal
    labels. Several matches are an error; none gives None. An exact name wins over longer ones."""
    axes = list(axes)
    if isinstance(query, Axis):
        found = [a for a in axes if a.name == query.name and a.same_as(query)]
    else:
        exact = [a for a in axes if a.name == query]
        if len(exact) == 1:
            return exact[0]
        q = query.lower()
        found = [a for a in axes if a.name.lower().startswith("ti" if q == "time" else q)]
    if len(found) > 1:
        raise AxisError(f"several axes match {query!r}: {', '.join(a.name for a in found)}")
    return found[0] if found else None


def get_axis(axes: Iterable[Axis], query: str | Axis) -> Axis:
    axes = list(axes)
    found = find_axis(axes, query)
    if found is None:
        raise AxisError(f"no axis matches {query!r} among {', '.join(a.name for a in axes)}")
    return found
