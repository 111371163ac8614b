"""Bounding boxes as four flat numeric columns.

Flat columns keep their minima and maxima in Parquet, so an overlap test on
them skips row groups; a struct or a geometry would not.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDES = ("xmin", "ymin", "xmax", "ymax")


@dataclass(frozen=True)
class Box:
    """A closed box: one that only touches another overlaps it."""

    xmin: float
    ymin: float
    xmax: float
    ymax: float

    @property
    def empty(self) -> bool:
        return self.xmin > self.xmax or self.ymin > self.ymax

    @property
    def area(self) -> float:
        return 0.0 if self.empty else (self.xmax - self.xmin) * (self.ymax - self.ymin)

    def grown(self, by: float) -> Box:
        return Box(self.xmin - by, self.ymin - by, self.xmax + by, self.ymax + by)

    def union(self, other: Box) -> Box:
        return Box(min(self.xmin, other.xmin), min(self.ymin, other.ymin), max(self.xmax, other.xmax), max(self.ymax, other.ymax))

    def including(self, x: float, y: float) -> Box:
        return self.union(Box(x, y, x, y))

    def columns(self) -> Columns:
        return Columns(*(F.lit(float(getattr(self, s))) for s in SIDES))


EMPTY = Box(float("inf"), float("inf"), float("-inf"), float("-inf"))


@dataclass(frozen=True)
class Columns:
    """The same box as expressions, a box a row."""

    xmin: Column
    ymin: Column
    xmax: Column
    ymax: Column

    @classmethod
    def named(cls, before: str = "") -> Columns:
        return cls(*(F.col(before + s) for s in SIDES))

    @classmethod
    def around(cls, x: Column, y: Column, half: Column | float = 0.0) -> Columns:
        return cls(x - half, y - half, x + half, y + half)

    def select(self, before: str = "") -> list[Column]:
        return [getattr(self, s).alias(before + s) for s in SIDES]

    def empty(self) -> Column:
        return (self.xmin > self.xmax) | (self.ymin > self.ymax)

    def overlaps(self, other: Box | Columns) -> Column:
        """True where the boxes share a point. Written as four comparisons of one column each, which scans can use."""
        o = other.columns() if isinstance(other, Box) else other
        meet = (self.xmin <= o.xmax) & (self.xmax >= o.xmin) & (self.ymin <= o.ymax) & (self.ymax >= o.ymin)
        return meet & ~self.empty() & ~o.empty()

    def contains(self, other: Box | Columns) -> Column:
        o = other.columns() if isinstance(other, Box) else other
        return (self.xmin <= o.xmin) & (self.xmax >= o.xmax) & (self.ymin <= o.ymin) & (self.ymax >= o.ymax)

    def union(self, other: Box | Columns) -> Columns:
        o = other.columns() if isinstance(other, Box) else other
        return Columns(F.least(self.xmin, o.xmin), F.least(self.ymin, o.ymin), F.greatest(self.xmax, o.xmax), F.greatest(self.ymax, o.ymax))

    def including(self, x: Column, y: Column) -> Columns:
        return self.union(Columns(x, y, x, y))

    def area(self) -> Column:
        return F.when(self.empty(), 0.0).otherwise((self.xmax - self.xmin) * (self.ymax - self.ymin))

    def grown_by_share(self, share: float, least: float = 1e-6) -> Columns:
        """Wider by ``share`` of its extent on every side, by ``least`` at least."""
        dx, dy = (F.greatest((high - low) * share, F.lit(least)) for low, high in ((self.xmin, self.xmax), (self.ymin, self.ymax)))
        return Columns(self.xmin - dx, self.ymin - dy, self.xmax + dx, self.ymax + dy)

    def extent(self) -> list[Column]:
        """Aggregates of the box around all rows."""
        return [F.min(self.xmin).alias("xmin"), F.min(self.ymin).alias("ymin"), F.max(self.xmax).alias("xmax"), F.max(self.ymax).alias("ymax")]

    def centre_within(self, x: float, y: float, radius: float) -> Column:
        """True where the box's nearest point lies within ``radius``; exact for points."""
        dx = F.greatest(self.xmin - x, F.lit(0.0), F.lit(x) - self.xmax)
        dy = F.greatest(self.ymin - y, F.lit(0.0), F.lit(y) - self.ymax)
        return (F.sqrt(dx * dx + dy * dy) <= radius) & ~self.empty()


def wkb_box(data: bytes | None) -> tuple[float, float, float, float] | None:
    """Bounds of a WKB or EWKB geometry; None for null, empty and broken ones.

    Reads points, line strings, polygons, their multi forms and collections,
    with Z and M in either notation.
    """
    if not data:
        return None
    xs: list[float] = []
    ys: list[float] = []

    def read(at: int) -> int:
        order = "<" if data[at] else ">"
        (code,) = struct.unpack_from(order + "I", data, at + 1)
        at += 5
        dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
        if code & 0x20000000:  # an SRID follows
            at += 4
        plain = code & 0x0FFFFFFF
        dims, kind = dims + (0, 1, 1, 2)[plain // 1000], plain % 1000

        def points(at: int, n: int) -> int:
            values = struct.unpack_from(f"{order}{n * dims}d", data, at)
            for x, y in zip(values[::dims], values[1::dims], strict=True):
                if x == x and y == y:  # an empty point is NaN
                    xs.append(x)
                    ys.append(y)
            return at + 8 * n * dims

        def count(at: int) -> tuple[int, int]:
            return struct.unpack_from(order + "I", data, at)[0], at + 4

        if kind == 1:
            return points(at, 1)
        n, at = count(at)
        if kind == 2:
            return points(at, n)
        for _ in range(n):
            if kind == 3:
                size, at = count(at)
                at = points(at, size)
            else:
                at = read(at)
        return at

    try:
        read(0)
    except (struct.error, IndexError):
        return None
    return (min(xs), min(ys), max(xs), max(ys)) if xs else None


@F.pandas_udf(T.StructType([T.StructField(s, T.DoubleType()) for s in SIDES]))
def _wkb_boxes(column: pd.Series) -> pd.DataFrame:
    found = [wkb_box(x) or (None,) * 4 for x in column]
    return pd.DataFrame(found, columns=list(SIDES), dtype="float64")


def from_wkb(geometry: Column | str) -> Columns:
    """Boxes of a binary geometry column; all sides null where it has none."""
    found = _wkb_boxes(geometry)
    return Columns(*(found[s] for s in SIDES))
