"""Vector tables from files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrill.functions import boxes as b
from quadrill.functions import labels as label_sets


def load_vectors(spark: SparkSession, path: str, *, id: str | None = None, embedding: str = "embedding", geometry: str | None = "geometry", labels: str | None = None, dims: int | None = None, format: str = "parquet") -> DataFrame:
    """A table of (id, embedding, labels, four box columns) and whatever else the files have.

    ``geometry`` holds WKB; only its bounds are used. Without ``id`` rows get
    numbers. ``dims`` makes vectors of another size an error.
    """
    df = spark.read.format(format).load(path)
    key: Column = F.monotonically_increasing_id() if id is None else F.col(id)
    v: Column = F.col(embedding).cast("array<float>")
    if dims is not None:
        v = F.when(F.col(embedding).isNull() | (F.size(embedding) == dims), v).otherwise(F.raise_error(F.lit(f"a vector does not have {dims} components")).cast("array<float>"))
    out = df.withColumn("id", key).withColumn("embedding", v)
    if labels is not None:
        out = out.withColumn("labels", label_sets.normalise(labels))
    if geometry is not None and geometry in df.columns:
        out = out.withColumns(dict(zip(b.SIDES, (getattr(b.from_wkb(geometry), s) for s in b.SIDES), strict=True)))
    return out


def points(df: DataFrame, x: Column, y: Column, half: Column | float = 0.0) -> DataFrame:
    """``df`` with box columns around a point each."""
    at = b.Columns.around(x, y, half)
    return df.withColumns({s: getattr(at, s) for s in b.SIDES})
