"""Exact top-k by inner product, with norm-bucketed pruning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrill.llm.store import materialise

#: Buckets hold vectors whose lengths differ by a factor of 2 ** (1 / STEPS) at most.
STEPS = 4
#: Rows of a block, and MB of queries that a round sends to every task.
BLOCK, ROUND_MB = 8192, 32
#: The FIRST longest vectors and one other in PILOT are searched first, for thresholds near the final ones.
FIRST, PILOT = 1024, 64
#: From this local cosine threshold on, coordinates prune better than lengths.
BY_COORDINATE = 0.6
FOCUS = 4


def quantised(vectors: DataFrame, vec_id: str, embedding: str, scale: float = 1024.0) -> DataFrame:
    """vec_id, q (floor(scale * x) of each component), dim, norm; only whole, finite vectors."""
    x = F.col(embedding)
    good = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    q = F.transform(x, lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("long"))
    out = vectors.where(good).select(F.col(vec_id).cast("long").alias("vec_id"), q.alias("q"))
    norm = F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    return out.withColumn("dim", F.size("q")).withColumn("norm", norm)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def products(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Integer inner products of the rows of ``a`` with ``b``; ``most`` bounds their size.

    Below 2**53 doubles are exact, below 2**63 longs; beyond that Python's
    integers are, and a product that no long can hold becomes the nearest one.
    """
    if most < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    if most < 2.0**63:
        return a @ b
    exact = a.astype(object) @ b.astype(object)
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k greatest scores, ties to the smaller id."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        rows = np.flatnonzero(score >= least)
    else:
        rows = np.arange(len(score))
    return rows[np.lexsort((ids[rows], -score[rows]))[:k]]


class Bucket:
    """A block of one bucket's vectors, longest first."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, q: np.ndarray, norms: np.ndarray):
        order = np.argsort(-norms, kind="stable")
        self.ids, self.rows, self.q, self.norms = ids[order], rows[order], q[order], norms[order]
        self.exact = self.q.astype(np.float64)
        self.longest = float(self.norms[0])
        self.unit = self.exact / np.where(self.norms > 0, self.norms, 1.0)[:, None]
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def by(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.sorted:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.sorted[f] = order, self.unit[order, f]
        return self.sorted[f]

    def search(self, query_row: int, q: np.ndarray, norm: float, least: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of this bucket's part of the k best with a score of ``least`` or more; the query's own row is none of them."""
        rows = self._candidates(q, norm, least)
        if rows is not None and not len(rows):
            return self.ids[:0], self.ids[:0]
        most = norm * self.longest * 1.001
        if most < 2.0**53:
            score = ((self.exact if rows is None else self.exact[rows]) @ q.astype(np.float64)).astype(np.int64)
        else:
            score = products(self.q if rows is None else self.q[rows], q, most)
        ids = self.ids if rows is None else self.ids[rows]
        keep = (self.rows if rows is None else self.rows[rows]) != query_row
        if least > -np.inf:
            keep &= score >= least
        ids, score = ids[keep], score[keep]
        top = best(score, ids, k)
        return ids[top], score[top]

    def _candidates(self, q: np.ndarray, norm: float, least: float) -> np.ndarray | None:
        """Rows that may reach ``least``; None for all."""
        if least <= 0 or not norm or not self.longest:
            return None if least <= 0 else self.ids[:0]
        local = least / (norm * self.longest)
        if local > 1 + 1e-9:
            return self.ids[:0]
        if local < BY_COORDINATE:  # by length
            n = int(np.searchsorted(-self.norms, -(least / norm) * (1 - 1e-9), side="right"))
            return None if n == len(self.ids) else np.arange(n)
        # By coordinate: a vector within angle A of the query lies, on an axis
        # at angle B from the query, between cos(B + A) and cos(B - A).
        unit, a = q / norm, np.arccos(min(1.0, local))
        focus = np.argsort(-np.abs(unit))[:FOCUS]
        b = np.arccos(np.clip(unit[focus], -1, 1))
        low, high = np.cos(np.minimum(np.pi, b + a)) - 1e-9, np.cos(np.maximum(0.0, b - a)) + 1e-9
        spans = [(np.searchsorted(self.by(f)[1], lo, "left"), np.searchsorted(self.by(f)[1], hi, "right")) for f, lo, hi in zip(focus, low, high, strict=True)]
        chosen = int(np.argmin([j - i for i, j in spans]))
        rows = self.by(focus[chosen])[0][slice(*spans[chosen])]
        for f, lo, hi in zip(focus, low, high, strict=True):
            x = self.unit[rows, f]
            rows = rows[(x >= lo) & (x <= hi)]
        return rows


FOUND = "query_row long, query_id long, vec_id long, score long"
QUERY = "query_row long, query_id long, q array<long>, dim int, norm double"


class Queries:
    """The queries of a round by their number of components, greatest length first."""

    def __init__(self, rows: pa.Table):
        self.by_dim: dict[int, tuple[np.ndarray, ...]] = {}
        dims = rows.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            some = rows.filter(pa.array(dims == dim))
            self.by_dim[dim] = (*(some.column(c).to_numpy() for c in ("query_row", "query_id", "norm", "least")), _matrix(some.column("q")) if dim else None)


def _block(queries: Queries, dim: int, ids: np.ndarray, rows: np.ndarray, q: np.ndarray | None, norms: np.ndarray, k: int) -> pa.RecordBatch:
    """What a block of vectors with ``dim`` components adds to the k best of each query that can reach it."""
    found: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    for by_row, by_id, by_norm, least, vectors in [queries.by_dim[dim]] if dim in queries.by_dim else ():
        if not dim:  # vectors without components all score 0
            order = np.argsort(ids, kind="stable")
            for row, one in zip(by_row.tolist(), by_id.tolist(), strict=True):
                some = order[rows[order] != row][:k]
                found.append((row, one, ids[some], np.zeros(len(some), np.int64)))
            continue
        steps = np.where(norms > 0, np.floor(np.log2(np.where(norms > 0, norms, 1.0)) * STEPS), -np.inf)
        for step in np.unique(steps)[::-1]:  # longest first
            some = steps == step
            held = Bucket(ids[some], rows[some], q[some], norms[some])
            reach = np.flatnonzero(by_norm * held.longest * 1.000001 >= least)
            for i in reach.tolist():
                found.append((int(by_row[i]), int(by_id[i]), *held.search(int(by_row[i]), vectors[i], float(by_norm[i]), float(least[i]), k)))
    times = [len(x[2]) for x in found]
    return pa.record_batch(
        {
            "query_row": pa.array(np.repeat([x[0] for x in found], times).astype(np.int64)),
            "query_id": pa.array(np.repeat([x[1] for x in found], times).astype(np.int64)),
            "vec_id": pa.array(np.concatenate([np.empty(0, np.int64), *(x[2] for x in found)])),
            "score": pa.array(np.concatenate([np.empty(0, np.int64), *(x[3] for x in found)])),
        }
    )


def _searched(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Each task's part of the k best of ``queries`` (a round of bounded size, with ``least``)."""
    sent = rows.sparkSession.sparkContext.broadcast(queries.toArrow())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Queries(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                dims = part.column("dim").to_numpy()
                for dim in np.unique(dims).tolist():
                    some = part.filter(pa.array(dims == dim))
                    yield _block(held, dim, *(some.column(c).to_numpy() for c in ("vec_id", "row")), _matrix(some.column("q")) if dim else None, some.column("norm").to_numpy(), k)

    return rows.select("vec_id", "row", "q", "dim", "norm").mapInArrow(search, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k)


def top_k(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best, ties to the smaller vec_id.

    Every row whose id is divisible by ``every`` is a query, and all other rows
    with as many components are its candidates: rows that repeat an id are
    queries and candidates one by one, each with ranks of its own and each a
    candidate of the others. Vectors that are null, or hold a null or non-finite
    component, take no part; nor do rows without an id. Zero vectors score 0. An
    empty table gives no rows.

    Vectors are written once, longest first. Queries go to the tasks in rounds
    of ``ROUND_MB`` at most, so no vector is copied or shuffled. A round first
    searches the longest vectors and one in ``PILOT`` of the others: the k-th
    score so far is each query's threshold. A block groups its vectors by length, skips groups
    whose length cannot reach the threshold, prunes inside the others by length
    or by coordinates, as the local cosine threshold says, and verifies what is
    left. What tasks send on is k rows a query and block at most.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, vec_id, embedding).where("vec_id is not null").withColumn("row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(F.desc("dim"), F.desc("norm"), "row").sortWithinPartitions(F.desc("dim"), F.desc("norm"))
    rows = materialise(rows.withColumn("place", F.monotonically_increasing_id()), "vectors")
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), "q", "dim", "norm")
    size = asked.agg(F.sum(8 * (F.col("dim") + 4))).first()[0] or 0
    rounds = max(1, int(-(-size // (ROUND_MB * 1_000_000))))
    pilot = rows.where((F.col("place") < FIRST) | (F.pmod(F.xxhash64("row"), F.lit(PILOT)) == 0))
    out = None
    for n in range(rounds):
        some = asked if rounds == 1 else asked.where(F.pmod(F.xxhash64("query_row"), F.lit(rounds)) == n)
        if size:
            first = _searched(pilot, some.withColumn("least", F.lit(float("-inf"))), k)
            least = _best(first, k).groupBy("query_row").agg(F.min("score").alias("score"), F.count("*").alias("n"))
            known = least.where(F.col("n") == k).select("query_row", F.col("score").cast("double").alias("least"))
            some = some.join(known, "query_row", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
        else:
            some = some.withColumn("least", F.lit(float("-inf")))
        found = _best(_searched(rows, some, k), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        if rounds > 1:  # one after another
            found = materialise(found, f"round-{n}")
        out = found if out is None else out.unionByName(found)
    return out
