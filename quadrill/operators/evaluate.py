"""How good and how fast a result is."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recall(truth: DataFrame, result: DataFrame, id: str = "id") -> DataFrame:
    """(hits, wanted, recall): how many of the true rows a result has."""
    right = truth.select(id).distinct()
    hits = right.join(result.select(id).distinct(), id).agg(F.count("*").alias("hits"))
    return hits.crossJoin(right.agg(F.count("*").alias("wanted"))).withColumn("recall", F.try_divide("hits", "wanted"))


def violations(base: DataFrame, result: DataFrame, predicate: Column, id: str = "id") -> DataFrame:
    """(violations): rows of a result whose base row fails the filter; always 0 if filters are exact."""
    return base.join(result.select(id), id).where(~F.coalesce(predicate, F.lit(False))).agg(F.count("*").alias("violations"))


def effective_qps(hits: int, k: int, latency_ms: float) -> float:
    """Queries a second, weighted by recall."""
    return hits / k * 1000 / latency_ms


def timed(run: Callable[[], DataFrame], times: int = 5) -> list[float]:
    """Seconds of several warm runs; the first, cold one is left out."""
    out = []
    for _ in range(times + 1):
        began = time.perf_counter()
        run().collect()
        out.append(time.perf_counter() - began)
    return out[1:]
