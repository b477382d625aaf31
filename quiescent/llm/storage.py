"""Lineage cuts that survive the loss of an executor.

Intermediate tables go to the folder the cluster names in ``spark.checkpoint.dir``.
Where that is unset (single-machine tests) a folder of our own is used; on a
cluster without the setting the call fails, because no local folder is shared.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a side may have to be broadcast. Its size is always counted first.
BROADCAST_ROWS = 200_000


def scratch_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return "file:///tmp/checkpoints"
    raise ValueError("spark.checkpoint.dir must name a folder that all executors share")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder's name below :func:`scratch_dir`."""
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Delete ``path`` when the application ends."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def materialize(df: DataFrame, label: str, file_rows: int = 0) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it; what is not discarded before is deleted when the application ends.

    ``file_rows`` is for tables of large rows: a writer looks at what it holds every hundred
    rows, and a reader takes thousands of a file's rows at once. With it a file has so many at most.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    delete_at_end(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path  # type: ignore[attr-defined]
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that :func:`materialize` wrote and nothing reads any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a side whose counted ``rows`` stay under the bound; else leave the join to Spark."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone. The built-in ``lower`` is used where a text has nothing else to change."""
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, up, low))
