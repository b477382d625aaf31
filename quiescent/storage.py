"""Tables between the jobs of one operator, in the folder that all executors share.

They go to the folder the cluster names in ``spark.checkpoint.dir``. Where that is
unset, local sessions use one of their own; other sessions fail, for no local folder
is shared.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a side may have to be broadcast. They are always counted first.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return "file:///tmp/checkpoints"
    raise ValueError("spark.checkpoint.dir must name a folder that all executors share")


def _hadoop(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def new_folder(spark: SparkSession, label: str) -> str:
    """Name of a folder that does not exist yet; what is written there is deleted when the application ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    p, fs = _hadoop(spark, path)
    fs.deleteOnExit(p)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _hadoop(spark, path)
    return bool(fs.exists(p))


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _hadoop(spark, path)
    fs.delete(p, True)


def checkpointed(df: DataFrame, label: str = "table") -> DataFrame:
    """``df`` written once and read from there."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path  # type: ignore[attr-defined]
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that :func:`checkpointed` wrote and nothing reads any more."""
    for t in tables:
        if t is not None:
            delete(t.sparkSession, t._written)  # type: ignore[attr-defined]


def broadcast_counted(df: DataFrame, rows: int) -> DataFrame:
    """A side of ``rows`` counted rows, broadcast up to :data:`BROADCAST_ROWS`; beyond that Spark chooses the join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
