"""Binary codes of vectors: training, coding, ranking."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrill.functions import metrics
from quadrill.functions.metrics import Metric


def index_view(vector: Column | str, metric: Metric | str, dims: int = 0) -> Column:
    """What codes and graphs see: the first ``dims`` components, then unit length for the cosine."""
    v = metrics.prefix(vector, dims) if dims else metrics.as_column(vector)
    return metrics.normalise(v) if Metric.of(metric) is Metric.COSINE else v


@dataclass(frozen=True)
class Coder:
    """Mean and deviation of each component, and the bits it gets."""

    means: tuple[float, ...]
    deviations: tuple[float, ...]
    bits: int = 1

    @classmethod
    def trained(cls, df: DataFrame, embedding: str, metric: Metric | str, dims: int = 0, bits: int = 1) -> Coder:
        """One pass over all vectors; what comes back is as many rows as components."""
        rows = moments(df, embedding, metric, dims).orderBy("pos").collect()
        return cls(tuple(r["mean"] for r in rows), tuple(r["deviation"] for r in rows), bits)

    @property
    def words(self) -> int:
        return math.ceil(len(self.means) * self.bits / 64)

    def levels(self, x: np.ndarray) -> np.ndarray:
        """How many of a component's bits are set: by its mean, or by steps from -2 to 2 deviations."""
        if self.bits == 1:
            return (x > np.array(self.means)).astype(np.int64)
        with np.errstate(divide="ignore", invalid="ignore"):
            z = (x - np.array(self.means)) / np.array(self.deviations)
            steps = (z + 2) / (4 / (self.bits + 1))
        steps = np.where(np.isnan(steps), 0, steps)
        return np.clip(np.floor(steps), 0, self.bits).astype(np.int64)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes of the rows of ``x``, as longs: bit i of the code is bit i mod 64 of word i // 64."""
        set_bits = np.arange(self.bits) < self.levels(x)[:, :, None]
        flat = set_bits.reshape(len(x), -1)
        padded = np.zeros((len(x), self.words * 64), dtype=bool)
        padded[:, : flat.shape[1]] = flat
        return np.packbits(padded, axis=1, bitorder="little").view("<i8")

    def code(self, embedding: Column | str, metric: Metric | str, dims: int = 0) -> Column:
        """The code of a vector column: batches in numpy; a loop a component would be far slower."""
        m = Metric.of(metric)

        @F.pandas_udf("array<bigint>")
        def encoded(column: pd.Series) -> pd.Series:
            rows = column.notna().to_numpy()
            out: list[np.ndarray | None] = [None] * len(column)
            if rows.any():
                seen = viewed_rows(np.stack(column[rows].to_list()), m, dims)
                for k, c in zip(np.flatnonzero(rows), self.encode(seen), strict=True):
                    out[k] = c
            return pd.Series(out, dtype=object)

        return encoded(embedding)

    def gaps(self, q: np.ndarray) -> np.ndarray:
        """Square of the least distance from a component of ``q`` to the values of each level: (level, component).

        A little less than that, as levels and distances are rounded.
        """
        means, deviations = np.array(self.means), np.array(self.deviations)
        steps = np.arange(1, self.bits + 1)[:, None] * (4 / (self.bits + 1)) - 2
        edges = means[None] if self.bits == 1 else means + deviations * steps
        none = np.full((1, len(means)), np.inf)
        low, high = np.concatenate([-none, edges]), np.concatenate([edges, none])
        slack = 1e-9 * (1 + np.abs(q) + np.abs(edges).max(axis=0))
        with np.errstate(invalid="ignore"):
            gap = np.maximum(low - q, q - high) - slack
        return np.where(gap > 0, gap, 0.0) ** 2

    def possible(self, code: Column | str, near: Sequence[tuple[Sequence[float], float]]) -> Column:
        """True for codes of which some vector lies as near to one of the given points as its squared distance says."""
        tables = [(self.gaps(np.array(q, dtype=np.float64)), most * (1 + 1e-9) + 1e-12) for q, most in near]
        n, bits = len(self.means), self.bits

        @F.pandas_udf("boolean")
        def seen(column: pd.Series) -> pd.Series:
            rows = np.flatnonzero(column.notna())
            out = np.zeros(len(column), dtype=bool)
            if len(rows):
                words = np.stack(column.iloc[rows].to_list()).astype("<i8")
                flat = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")[:, : n * bits]
                levels = flat.reshape(len(words), n, bits).sum(axis=2)
                for table, most in tables:
                    out[rows] |= table[levels, np.arange(n)].sum(axis=1) <= most
            return pd.Series(out)

        return seen(code)

    def code_of(self, query: list[float]) -> list[int]:
        return self.encode(np.array([query], dtype=np.float64))[0].tolist()


def viewed_rows(x: np.ndarray, metric: Metric, dims: int = 0) -> np.ndarray:
    """``index_view`` of the rows of a matrix."""
    x = x[:, : dims or None].astype(np.float64)
    if metric is not Metric.COSINE:
        return x
    n2 = (x * x).sum(axis=1)
    return x / np.where(n2 < metrics.EPSILON, 1.0, np.sqrt(n2))[:, None]


def moments(df: DataFrame, embedding: str, metric: Metric | str, dims: int = 0) -> DataFrame:
    """(pos, mean, deviation) of each component over all vectors.

    Each task adds its vectors up, batch by batch, and sends one row a
    component: what is shuffled does not grow with the vectors.
    """
    m = Metric.of(metric)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, m2 = 0, np.zeros(0), np.zeros(0)
        for batch in batches:
            column = batch.column(0).drop_null()
            if not len(column):
                continue
            x = viewed_rows(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1), m, dims)
            k, own = len(x), x.mean(axis=0)
            apart = own - mean if n else own * 0
            m2 = ((x - own) ** 2).sum(axis=0) + (m2 + apart**2 * n * k / (n + k) if n else 0)
            mean = mean + apart * k / (n + k) if n else own
            n += k
        yield pa.record_batch({"pos": pa.array(np.arange(len(mean)), pa.int32()), "n": pa.array(np.full(len(mean), float(n))), "mean": pa.array(mean), "m2": pa.array(m2)})

    parts = df.where(F.col(embedding).isNotNull()).select(embedding).mapInArrow(added, "pos int, n double, mean double, m2 double")
    total = parts.groupBy("pos").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.sum(F.col("m2") + F.col("n") * F.col("mean") * F.col("mean")).alias("squares"))
    return total.select("pos", "mean", F.sqrt(F.greatest(F.lit(0.0), F.col("squares") / F.col("n") - F.col("mean") * F.col("mean"))).alias("deviation"))


def viewed(query: list[float], metric: Metric | str, dims: int = 0) -> list[float]:
    """``index_view`` of one query vector."""
    q = [float(x) for x in query][: dims or None]
    n2 = sum(x * x for x in q)
    return [x / math.sqrt(n2) for x in q] if Metric.of(metric) is Metric.COSINE and n2 >= metrics.EPSILON else q
