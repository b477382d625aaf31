"""Table functions that SQL can call: ``SELECT * FROM index_ranges(TABLE(t), 'rec_id', 'i', 2)``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


class IndexRanges:
    """Ranges of indices no further apart than a tolerance, in each series of a table.

    Arguments: the table, its key columns as one text with commas, the index column, and
    the tolerance. The function asks Spark for the rows of a series together and in
    order, and holds one open range while they pass by: a series may be of any length.
    Equal indices count one by one in ``n``; null ones are left out; null keys are a series.
    """

    def __init__(self) -> None:
        self.open: list | None = None

    @staticmethod
    def analyze(rows: AnalyzeArgument, keys: AnalyzeArgument, idx: AnalyzeArgument, tol: AnalyzeArgument) -> AnalyzeResult:
        kinds = {f.name: f for f in rows.dataType.fields}
        names = [k.strip() for k in keys.value.split(",") if k.strip()]
        lost = [c for c in (*names, idx.value) if c not in kinds]
        if not rows.isTable or lost or tol.value is None or tol.value < 0:
            raise ValueError(f"a table with {lost or 'its columns'} and a tolerance from 0 on wanted")
        out = StructType([kinds[k] for k in names] + [StructField(c, LongType()) for c in ("start_idx", "end_idx", "n")])
        return AnalyzeResult(out, withSinglePartition=not names, partitionBy=[PartitioningColumn(k) for k in names], orderBy=[OrderingColumn(idx.value)])

    def eval(self, row: Row, keys: str, idx: str, tol: int) -> Iterator[tuple]:
        i = row[idx]
        if i is None:
            return
        if self.open and i - self.open[2] <= tol:
            self.open[2], self.open[3] = i, self.open[3] + 1
            return
        if self.open:
            yield (*self.open[0], *self.open[1:])
        self.open = [tuple(row[k.strip()] for k in keys.split(",") if k.strip()), i, i, 1]

    def terminate(self) -> Iterator[tuple]:
        if self.open:
            yield (*self.open[0], *self.open[1:])
            self.open = None


def register(spark: SparkSession) -> None:
    """Make the functions of this module known to SQL."""
    spark.udtf.register("index_ranges", udtf(IndexRanges))
