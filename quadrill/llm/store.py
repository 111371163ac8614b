"""Files that the driver and every executor can see."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[object, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary folder, since there
    the driver is the only executor; on a cluster the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master.startswith("local") and not master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="quadrill-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_remove)
    _made.append((spark, path))
    return path


def _remove() -> None:
    for spark, path in _made:
        sc = spark.sparkContext
        if sc._jsc is None or sc._jvm is None:  # the session has ended already
            continue
        spark.sql(f"DROP TABLE IF EXISTS {path.rsplit('/', 1)[1].replace('-', '_')}")
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The new DataFrame has no lineage beyond those files, so nothing is computed
    twice and a lost executor costs a read.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """Write ``df`` to the shared folder, dealt by ``key``: joins by the key need no shuffle of it.

    The table has a name of its own in the session's catalog, which goes with the files.
    """
    spark, parts = df.sparkSession, shuffle_parts(df.sparkSession)
    path = scratch(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.repartition(parts, key).write.bucketBy(parts, key).format("parquet").option("path", path).saveAsTable(table)
    return spark.table(table)


def bounded_sample(df: DataFrame, key: Column, n: int, total: int) -> DataFrame:
    """``n`` rows of ``df``, those of least ``key`` (a hash), or all if there are fewer.

    ``total`` is about the number of rows: first only the share of hashes that
    is likely to hold ``n`` rows stays, so what meets in one task is not much
    more than the sample, however many tasks there are.
    """
    share = 1.25 * (n + 50) / max(total, 1)
    some = df if share >= 1 else df.where(F.pmod(key, F.lit(1 << 40)) < int(share * (1 << 40)))
    return some.orderBy(F.pmod(key, F.lit(1 << 40)), key).limit(n)


def spare_name(df: DataFrame, wish: str) -> str:
    """``wish``, or a longer name if the table has such a column."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Let batches between the JVM and Python have ``rows`` rows at most, so that whole texts take little memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
