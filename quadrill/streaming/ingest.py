"""Structured Streaming into an index, and running statistics of what arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quadrill.operators.index import SpatialIndex
from quadrill.plans.options import Settings


def ingest(stream: DataFrame, path: str, checkpoint: str, settings: Settings | None = None, **trigger) -> StreamingQuery:
    """Insert every micro-batch of ``stream`` into the index at ``path``.

    A batch that runs again after a failure buries what its first run may have
    inserted, as it replaces rows by id: each row is there once. Within a batch
    the last row of an id (by column ``ts`` if there is one) wins.
    """

    def add(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        if "ts" in batch.columns:
            columns = F.struct(*batch.columns)
            rows = batch.groupBy("id").agg(F.max_by(columns, "ts").alias("r")).select("r.*")
        else:
            rows = batch.dropDuplicates(["id"])
        SpatialIndex(batch.sparkSession, path).update(rows, settings)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def arrivals(stream: DataFrame, window: str = "10 minutes", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Rows and extent a window of event time; what comes later than ``late`` is left out."""
    sides = [F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax")]
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window).alias("window")).agg(F.count("*").alias("n"), *sides)
