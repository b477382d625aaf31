"""Recordings stored so that what belongs together lies together.

A table is bucketed and sorted by recording and block. Operators keyed by these columns
and others (references, montages, joins of the ranges of a block) then find their rows
in one task and in order: their plans have no exchange. A recording is many blocks, so
a long one is spread over all buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Samples of a block.
BLOCK = 1 << 16
BLOCK_COLUMN = "block"


def with_block(samples: DataFrame, idx: str = "i", size: int = BLOCK) -> DataFrame:
    """``samples`` with the number of the block that their index falls into."""
    return samples.withColumn(BLOCK_COLUMN, F.floor((F.col(idx) - 1) / size).cast("long"))


def blocks_of_ranges(ranges: DataFrame, start: str = "start_idx", end: str = "end_idx", size: int = BLOCK) -> DataFrame:
    """``ranges`` once for each block that they reach into."""
    first, last = (F.floor((F.col(c) - 1) / size).cast("long") for c in (start, end))
    return ranges.withColumn(BLOCK_COLUMN, F.explode(F.sequence(first, last)))


def save_bucketed(df: DataFrame, table: str, folder: str, keys: list[str], buckets: int, order: list[str] | None = None) -> DataFrame:
    """Write ``df`` as the table ``table`` in ``folder``, bucketed by ``keys`` and the block, sorted by these and ``order``; gives the table.

    Two tables with the same keys and number of buckets are joined bucket by bucket. The
    rows are dealt out once here, a task a bucket, so that each bucket is one file.
    """
    by = [*keys, BLOCK_COLUMN]
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    dealt = df.repartition(buckets, *by)
    dealt.write.bucketBy(buckets, *by).sortBy(*by, *(order or [])).option("path", folder).mode("overwrite").saveAsTable(table)
    return spark.table(table)


def in_ranges(spark: SparkSession, samples: str, ranges: str, keys: list[str], idx: str = "i", start: str = "start_idx", end: str = "end_idx") -> DataFrame:
    """Rows of the table ``samples`` with the columns of the ranges in the table ``ranges`` that hold them.

    Both are tables of :func:`save_bucketed` with the same keys and buckets, ranges
    after :func:`blocks_of_ranges`; a block's samples meet its ranges alone, in its bucket.
    """
    r = spark.table(ranges)
    same = [*keys, BLOCK_COLUMN]
    joined = spark.table(samples).hint("merge").join(r, same)
    return joined.where(F.col(idx).between(F.col(start), F.col(end)))
