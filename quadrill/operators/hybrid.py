"""Spatial candidates first, then exact distances: six table functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrill.functions import metrics
from quadrill.functions.boxes import Box, Columns
from quadrill.functions.metrics import Metric


def _checked(k: int, candidate_limit: int, radius: float = 0.0) -> None:
    if k <= 0:
        raise ValueError("k must be positive")
    if candidate_limit <= 0:
        raise ValueError("candidate_limit must be positive")
    if radius < 0:
        raise ValueError("radius must not be negative")


def _top(found: DataFrame, metric: Metric, id: str, embedding: str, query: Sequence[float], k: int, candidate_limit: int) -> DataFrame:
    # The cut goes by id, so that the same rows are candidates every time.
    some = found.where(F.col(embedding).isNotNull()).select(F.col(id).alias("id"), F.col(embedding).alias("v")).orderBy("id").limit(candidate_limit)
    near = some.select("id", metrics.distance(metric, "v", query).alias("distance")).orderBy("distance", "id").limit(k)
    return near.select(F.col("id").cast("string").alias("row_id"), "distance")


def hybrid_bbox(df: DataFrame, box: Box, query: Sequence[float], k: int = 20, candidate_limit: int = 2000, *, metric: Metric | str, id: str = "id", embedding: str = "embedding", boxes: Columns | None = None) -> DataFrame:
    """(row_id, distance) of the k nearest among ``candidate_limit`` rows that overlap ``box``."""
    _checked(k, candidate_limit)
    return _top(df.where((boxes or Columns.named()).overlaps(box)), Metric.of(metric), id, embedding, query, k, candidate_limit)


def hybrid_dwithin(df: DataFrame, x: float, y: float, radius: float, query: Sequence[float], k: int = 20, candidate_limit: int = 2000, *, metric: Metric | str, id: str = "id", embedding: str = "embedding", boxes: Columns | None = None) -> DataFrame:
    """The same within ``radius`` of a point, in units of the coordinates; the widened box prunes the scan."""
    _checked(k, candidate_limit, radius)
    at = boxes or Columns.named()
    near = df.where(at.overlaps(Box(x, y, x, y).grown(radius))).where(at.centre_within(x, y, radius))
    return _top(near, Metric.of(metric), id, embedding, query, k, candidate_limit)


def install(spark: SparkSession) -> bool:
    """SQL functions of the session: distances, type ids, label and box tests. True once they are there."""
    doubles, labels = "ARRAY<DOUBLE>", "ARRAY<SMALLINT>"
    dot = "aggregate(zip_with({}, {}, (x, y) -> x * y), 0D, (s, t) -> s + t)"
    l2 = "aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, t) -> s + t)"
    same = "IF(size(a) = size(b), {}, CAST(raise_error('vectors differ in size') AS DOUBLE))"
    norms = f"sqrt({dot.format('a', 'a')} * {dot.format('b', 'b')})"
    cosine = f"CASE WHEN {norms} = 0 THEN 1D ELSE greatest(0D, 1 - {dot.format('a', 'b')} / {norms}) END"
    box = "x{0}min DOUBLE, y{0}min DOUBLE, x{0}max DOUBLE, y{0}max DOUBLE"
    made = {
        f"l2_distance(a {doubles}, b {doubles}) RETURNS DOUBLE": same.format(f"sqrt({l2})"),
        f"l2_squared_distance(a {doubles}, b {doubles}) RETURNS DOUBLE": same.format(l2),
        f"negative_inner_product(a {doubles}, b {doubles}) RETURNS DOUBLE": same.format(f"-{dot.format('a', 'b')}"),
        f"cosine_distance(a {doubles}, b {doubles}) RETURNS DOUBLE": same.format(cosine),
        f"smallint_array_overlap(a {labels}, b {labels}) RETURNS BOOLEAN": "coalesce(arrays_overlap(array_compact(a), array_compact(b)), false)",
        f"bbox_overlaps({box.format('a')}, {box.format('b')}) RETURNS BOOLEAN": "xamin <= xbmax AND xamax >= xbmin AND yamin <= ybmax AND yamax >= ybmin AND xamin <= xamax AND yamin <= yamax AND xbmin <= xbmax AND ybmin <= ybmax",
    } | {f"distance_type_{name}() RETURNS SMALLINT": f"CAST({m.type_id} AS SMALLINT)" for name, m in (("cosine", Metric.COSINE), ("l2", Metric.L2), ("inner_product", Metric.IP))}
    for head, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION quadrill_{head} RETURN {body}")
    return True


def install_tables(spark: SparkSession, table: str, *, id: str = "id", embedding: str = "embedding", prefix: str = "quadrill") -> list[str]:
    """SQL table functions over ``table`` (a view or table with box columns), for each metric; their names.

    ``hybrid_bbox_<metric>(query, xmin, ymin, xmax, ymax, k, candidate_limit)``
    and ``hybrid_dwithin_<metric>(query, x, y, radius, k, candidate_limit)`` give
    (row_id, distance), nearest first by their callers' ORDER BY. The functions
    of ``install`` come with them; bad arguments are errors.
    """
    install(spark)
    box = "quadrill_bbox_overlaps(xmin, ymin, xmax, ymax, {0})"
    near = "sqrt(pow(greatest(xmin - x, 0D, x - xmax), 2) + pow(greatest(ymin - y, 0D, y - ymax), 2)) <= radius"
    kinds = {
        "bbox": ("bxmin DOUBLE, bymin DOUBLE, bxmax DOUBLE, bymax DOUBLE", box.format("bxmin, bymin, bxmax, bymax"), "0D"),
        "dwithin": ("x DOUBLE, y DOUBLE, radius DOUBLE", f"{box.format('x - radius, y - radius, x + radius, y + radius')} AND {near}", "radius"),
    }
    distances = {"l2": "l2_distance", "cosine": "cosine_distance", "ip": "negative_inner_product"}
    made = []
    for kind, (parameters, where, radius) in kinds.items():
        for metric, f in distances.items():
            name = f"{prefix}_hybrid_{kind}_{metric}"
            good = f"assert_true(k > 0 AND candidate_limit > 0 AND {radius} >= 0D, 'k and candidate_limit must be positive, the radius not negative') IS NULL"
            some = f"SELECT {id} AS i, {embedding} AS v, row_number() OVER (ORDER BY {id}) AS place FROM {table} WHERE {where} AND {embedding} IS NOT NULL"
            ranked = f"SELECT i, quadrill_{f}(v, query) AS distance FROM ({some}) WHERE place <= candidate_limit"
            spark.sql(
                f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(query ARRAY<DOUBLE>, {parameters}, k INT, candidate_limit INT) RETURNS TABLE (row_id STRING, distance DOUBLE) RETURN "
                f"SELECT CAST(i AS STRING) AS row_id, distance FROM (SELECT i, distance, row_number() OVER (ORDER BY distance, i) AS place FROM ({ranked})) WHERE place <= k AND {good}"
            )
            made.append(name)
    return made
