"""Distances between vectors as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: vectors of a lower squared norm are not normalised.
EPSILON = 1.1920929e-07
#: A query of so many components at most becomes one compiled expression: on 384
#: five times as fast as higher-order functions, on 1024 slower, as it has to be compiled.
UNROLL = 512

Vector = Column | str | Sequence[float]


class Metric(Enum):
    """Distances by which rows are ordered, nearest first, and their fixed type ids."""

    COSINE = ("cosine", 0, "<=>")
    L2 = ("l2", 1, "<->")
    IP = ("ip", 2, "<#>")

    def __init__(self, title: str, type_id: int, operator: str):
        self.title, self.type_id, self.operator = title, type_id, operator

    @classmethod
    def of(cls, wish: Metric | str | int) -> Metric:
        for m in cls:
            if wish is m or wish in (m.title, m.type_id, m.operator):
                return m
        raise ValueError(f"unknown metric {wish!r}")


def _col(v: Column | str) -> Column:
    return F.col(v) if isinstance(v, str) else v


def _literal(v: Vector) -> list[float] | None:
    return None if isinstance(v, str | Column) else [float(x) for x in v]


def as_column(v: Vector) -> Column:
    """A vector column of doubles, from a column, its name or numbers."""
    values = _literal(v)
    return F.transform(_col(v), lambda x: x.cast("double")) if values is None else F.array(*map(F.lit, values)).cast("array<double>")


def same_dims(a: Column, n: Column | int) -> Column:
    """0 where the vector has ``n`` components, null where it is null, else an error.

    It is added to a distance rather than put around it: inside a condition the
    components' terms would be one method too long for the JIT compiler, which
    measured twenty times as slow.
    """
    size, wanted = F.size(a), F.lit(n) if isinstance(n, int) else n
    wrong = F.raise_error(F.concat(F.lit("vectors have "), size.cast("string"), F.lit(" and "), wanted.cast("string"), F.lit(" components")))
    return F.when(a.isNull() | wanted.isNull() | (wanted < 0), F.lit(None).cast("double")).when(size == wanted, F.lit(0.0)).otherwise(wrong.cast("double"))


#: Terms of one compiled method.
CHUNK = 24


def _terms(a: Column | str, values: list[float], term: str) -> Column:
    """A balanced sum of ``term`` over components x of ``a`` and numbers y, as one expression.

    Each chunk's sum s is written (s + s) / 2, which is exact below half of the
    greatest double: a subexpression
    that occurs twice becomes a method of its own, and methods of more than 8000
    bytes are never compiled. It is written as SQL, which the parser reads at
    once; hundreds of Column objects take half a second to make.
    """

    def tree(parts: list, plus) -> object:
        while len(parts) > 1:
            parts = [plus(p, q) for p, q in zip(parts[::2], parts[1::2], strict=False)] + parts[len(parts) // 2 * 2 :]
        return parts[0]

    chunks = [range(k, min(k + CHUNK, len(values))) for k in range(0, len(values), CHUNK)]
    if not isinstance(a, str):
        made = {"sq": lambda x, y: (x - y) * (x - y), "mul": lambda x, y: x * y, "own": lambda x, y: x * x}[term]
        sums = [tree([made(a[i].cast("double"), F.lit(values[i])) for i in c], lambda p, q: p + q) for c in chunks]
        return tree([(s + s) * 0.5 for s in sums], lambda p, q: p + q)
    name = ".".join(f"`{part}`" for part in a.replace("`", "").split("."))

    def written(i: int) -> str:
        x, y = f"CAST({name}[{i}] AS DOUBLE)", f"CAST('{values[i]!r}' AS DOUBLE)"
        return {"sq": f"({x} - {y}) * ({x} - {y})", "mul": f"{x} * {y}", "own": f"{x} * {x}"}[term]

    sums = [tree([written(i) for i in c], lambda p, q: f"({p} + {q})") for c in chunks]
    return F.expr(tree([f"(({s} + {s}) * 0.5D)" for s in sums], lambda p, q: f"({p} + {q})"))


def _short(a: Vector, b: Vector) -> list[float] | None:
    """The numbers of a query that is short enough to be unrolled."""
    values = _literal(b)
    return values if values is not None and 0 < len(values) <= UNROLL and _literal(a) is None else None


def _sum(a: Vector, b: Vector, term: str) -> Column:
    """Sum over components; compiled into one loop-free expression for a short query."""
    values = _short(a, b)
    if values is not None:
        return same_dims(_col(a), len(values)) + _terms(a, values, term)
    x, y = as_column(a), as_column(b)
    each = {"sq": lambda p, q: (p - q) * (p - q), "mul": lambda p, q: p * q}[term]
    return same_dims(x, F.size(y)) + F.aggregate(F.zip_with(x, y, each), F.lit(0.0), lambda s, t: s + t)


def l2_squared(a: Vector, b: Vector) -> Column:
    return _sum(a, b, "sq")


def l2(a: Vector, b: Vector) -> Column:
    return F.sqrt(l2_squared(a, b))


def dot(a: Vector, b: Vector) -> Column:
    return _sum(a, b, "mul")


def negative_inner_product(a: Vector, b: Vector) -> Column:
    return -dot(a, b)


def norm_squared(a: Vector) -> Column:
    values = _literal(a)
    if values is not None:
        return F.lit(math.fsum(x * x for x in values))
    return F.aggregate(as_column(a), F.lit(0.0), lambda s, x: s + x * x)


def normalise(a: Vector) -> Column:
    """Unit vector; a vector of (nearly) no length stays as it is."""
    n2, v = norm_squared(a), as_column(a)
    return F.when(n2 < EPSILON, v).otherwise(F.transform(v, lambda x: x / F.sqrt(n2)))


def cosine(a: Vector, b: Vector) -> Column:
    """``max(0, 1 - cos)``; 1 where a vector has no length."""
    values = _short(a, b)
    if values is not None:
        product, over = F.lit(math.fsum(y * y for y in values)) * _terms(a, values, "own"), _terms(a, values, "mul")
        sized = same_dims(_col(a), len(values))
    else:
        x, y = as_column(a), as_column(b)
        product, over = norm_squared(a) * norm_squared(b), F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
        sized = same_dims(x, F.size(y))
    # Both sums stand outside of conditions, for the reason that same_dims gives.
    scale = F.when(product >= EPSILON * EPSILON, 1 / F.sqrt(product)).otherwise(0.0)
    return sized + F.greatest(F.lit(0.0), 1 - over * scale)


def distance(metric: Metric | str | int, a: Vector, b: Vector) -> Column:
    return {Metric.COSINE: cosine, Metric.L2: l2, Metric.IP: negative_inner_product}[Metric.of(metric)](a, b)


def prefix(a: Vector, n: int) -> Column:
    """The first ``n`` components: what an index over fewer dimensions sees."""
    return F.slice(as_column(a), 1, n)


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def hamming(a: Column | str, b: Column | str | Sequence[int]) -> Column:
    """Number of bits in which two codes (arrays of longs) differ."""
    if not isinstance(b, str | Column):
        v, total = _col(a), F.lit(0)
        for i, x in enumerate(b):
            total = total + F.bit_count(v[i].bitwiseXOR(F.lit(int(x)).cast("long")))
        return total
    other = _col(b)
    return F.aggregate(F.zip_with(_col(a), other, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
