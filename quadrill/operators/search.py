"""Top-k search by distance under box, label and any other filters."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrill.functions import labels as label_sets
from quadrill.functions import metrics
from quadrill.functions.boxes import Box, Columns
from quadrill.functions.metrics import Metric
from quadrill.operators.codes import Coder, viewed


def query_vector(df: DataFrame, id: str, value: object, embedding: str = "embedding") -> list[float] | None:
    """A stored row's vector, to search by: one row of one column comes to the driver."""
    rows = df.where(F.col(id) == F.lit(value)).select(metrics.as_column(embedding).alias("v")).take(1)
    return rows[0]["v"] if rows else None


def filtered(df: DataFrame, *, embedding: str = "embedding", box: Box | None = None, boxes: Columns | None = None, labels: Iterable[int] | None = None, label_column: str = "labels", where: Column | None = None) -> DataFrame:
    """Rows that a search may return: those with a vector that pass every filter, exactly."""
    out = df.where(F.col(embedding).isNotNull())
    if box is not None:
        out = out.where((boxes or Columns.named()).overlaps(box))
    if labels is not None:
        out = out.where(label_sets.overlap(label_column, list(labels)))
    return out if where is None else out.where(where)


def search(
    df: DataFrame,
    query: Sequence[float] | None,
    k: int | None = 20,
    *,
    id: str = "id",
    embedding: str = "embedding",
    metric: Metric | str = Metric.COSINE,
    box: Box | None = None,
    boxes: Columns | None = None,
    labels: Iterable[int] | None = None,
    label_column: str = "labels",
    where: Column | None = None,
    order: Sequence[Column | str] | None = None,
    dims: int = 0,
) -> DataFrame:
    """Rows of ``df`` with their ``distance``, nearest first, ties by id; exact.

    ``k`` None returns all. ``dims`` ranks by the first so many components. A
    null query stands for the zero vector. ``order`` replaces (distance, id).
    Filters and the columns they need reach the scan, each task keeps its k
    nearest and only those are merged: no shuffle of the table.
    """
    if k is not None and k <= 0:
        raise ValueError("k must be positive")
    rows = filtered(df, embedding=embedding, box=box, boxes=boxes, labels=labels, label_column=label_column, where=where)
    v: Column | str = embedding  # by name: distances of named columns are made faster
    if query is None:
        d = F.lit(0.0) if Metric.of(metric) is not Metric.L2 else F.sqrt(metrics.norm_squared(v))
        d = F.lit(1.0) if Metric.of(metric) is Metric.COSINE else d
    else:
        q = [float(x) for x in query]
        if dims:
            v, q = metrics.prefix(v, dims), q[:dims]
        d = metrics.distance(metric, v, q)
    out = rows.withColumn("distance", d).orderBy(*(order or ("distance", id)))
    return out if k is None else out.limit(k)


def search_by_row(df: DataFrame, queries: DataFrame, k: int, *, id: str = "id", embedding: str = "embedding", metric: Metric | str = Metric.COSINE) -> DataFrame:
    """``search`` whose query vector is a one-row DataFrame with a column ``query``: a scalar subquery in a plan."""
    one = queries.select(F.col("query").alias("__query")).limit(1)
    rows = filtered(df, embedding=embedding).crossJoin(F.broadcast(one))  # one row, by its limit
    return rows.withColumn("distance", metrics.distance(metric, embedding, F.col("__query"))).drop("__query").orderBy("distance", id).limit(k)


def rescored(df: DataFrame, code: str, coder: Coder, query: Sequence[float], k: int, *, rescore: int, id: str = "id", embedding: str = "embedding", metric: Metric | str = Metric.COSINE, dims: int = 0, exact: bool = False) -> DataFrame:
    """The ``rescore`` rows of nearest code (``k`` at least), then the k nearest of them by their vectors.

    Without rescoring (0) the order of the codes stands. ``exact`` gives the k
    nearest of all rows: the distance of the k-th of the rescored rows bounds
    what can be nearer, and every other row whose code allows such a distance is
    ranked by its vector too. Codes say nothing of inner products, nor of the
    cosine if they are of fewer components; all rows are ranked then.
    """
    q = viewed(list(query), metric, dims)
    coded = df.where(F.col(code).isNotNull()).withColumn("code_distance", metrics.hamming(code, coder.code_of(q)))
    near = coded.orderBy("code_distance", id).limit(max(k, rescore))
    far = metrics.distance(metric, embedding, [float(x) for x in query])
    if exact:
        worst = near.select(far.alias("distance")).orderBy("distance").limit(k).agg(F.count("*").alias("n"), F.max("distance").alias("most")).first()
        near = coded if worst["n"] < k else _within_reach(coded, code, coder, q, worst["most"], Metric.of(metric), dims)
    found = near.withColumn("distance", far)
    return found.orderBy(*(("distance", id) if rescore or exact else ("code_distance", id))).limit(k)


def _within_reach(df: DataFrame, code: str, coder: Coder, q: list[float], most: float, metric: Metric, dims: int) -> DataFrame:
    """Rows whose codes allow a distance of ``most``; all where that can't be told."""
    if not math.isfinite(most):
        return df
    if metric is Metric.L2:
        return df.where(coder.possible(code, [(q, most * most)]))
    if metric is Metric.COSINE and not dims and math.fsum(x * x for x in q) >= 0.5:
        # Of unit vectors the squared distance is twice the cosine's; vectors of (nearly) no length stay as they are.
        return df.where(coder.possible(code, [(q, 2 * most), ([0.0] * len(q), metrics.EPSILON)]))
    return df


def coded(df: DataFrame, *, embedding: str = "embedding", metric: Metric | str = Metric.COSINE, bits: int = 1, dims: int = 0, name: str = "code") -> tuple[DataFrame, Coder]:
    """``df`` with a column of codes, and the coder that its vectors trained."""
    coder = Coder.trained(df, embedding, metric, dims, bits)
    return df.withColumn(name, coder.code(embedding, metric, dims)), coder
