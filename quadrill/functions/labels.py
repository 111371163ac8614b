"""Sets of small integers as sorted arrays without repeats or nulls."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPE = "array<smallint>"


def _array(labels: Column | str | Iterable[int | None]) -> Column:
    if isinstance(labels, str):
        return F.col(labels)
    return labels if isinstance(labels, Column) else F.array(*[F.lit(x) for x in labels]).cast(TYPE)


def normalise(labels: Column | str | Iterable[int | None]) -> Column:
    """The set as it is stored: a null array, an empty one and one of nulls are the empty set."""
    return F.array_sort(F.array_distinct(F.array_compact(F.coalesce(_array(labels).cast(TYPE), F.array().cast(TYPE)))))


def overlap(a: Column | str | Iterable[int | None], b: Column | str | Iterable[int | None]) -> Column:
    """True where a non-null label is in both; false, not null, where a side is empty or null."""
    return F.coalesce(F.arrays_overlap(F.array_compact(_array(a)), F.array_compact(_array(b))), F.lit(False))


def contains_intersection(holder: Column | str, a: Column | str, b: Column | str) -> Column:
    """True where all labels that ``a`` and ``b`` share are in ``holder``."""
    return F.size(F.array_except(F.array_intersect(normalise(a), normalise(b)), normalise(holder))) == 0
