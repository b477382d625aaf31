"""Labelled texts dealt into shards of bounded size, which are learned from one by one.

A shard is made of hashes of ids and texts and read in their order, so that the same
tables give the same shards however they are partitioned. What the shards have
learned is added as whole numbers, whose sum knows no order, and averaged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import broadcast_if_small

#: Rows of every label that a shard has about, at least; a label with fewer is given to several shards.
LEAST = 20
#: Fixed-point unit of what is added.
UNIT = 1 << 20


def key() -> F.Column:
    """The hash of a row that says where it goes."""
    return F.xxhash64("doc_id", "text", F.lit(17))


def sharded(rows: DataFrame, by: str, sizes: dict[object, int], size: int) -> tuple[DataFrame, int]:
    """``rows(by, text, h_)`` with their ``shard``, and the number of shards of about ``size`` rows.

    Every row is in a shard. Rows of a rare value are in as many as it takes for a
    shard to have :data:`LEAST` of them, or in all.
    """
    n = max(1, -(-sum(sizes.values()) // size))
    copies = [(k, min(n, -(-LEAST * n // c))) for k, c in sizes.items()]
    kind = rows.schema[by].dataType.simpleString()
    times = rows.sparkSession.createDataFrame(copies, f"{by} {kind}, copies_ int")
    first = F.pmod(F.xxhash64("h_"), F.lit(n))
    out = rows.join(broadcast_if_small(times, len(copies)), by).withColumn("copy_", F.explode(F.sequence(F.lit(0), F.col("copies_") - 1)))
    return out.select(by, "text", "h_", F.pmod(first + F.col("copy_"), F.lit(n)).cast("int").alias("shard")).repartition(n, "shard"), n


def in_order(table: pa.Table, by: str) -> list[tuple[str, object]]:
    """(text, label) of a shard by hash, text and label."""
    rows = sorted(zip(table["h_"].to_pylist(), table["text"].to_pylist(), table[by].to_pylist(), strict=True))
    return [(t, k) for _, t, k in rows]


def fixed(x: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(np.asarray(x, np.float64), -2000, 2000) * UNIT).astype(np.int32)


def added(parts: DataFrame) -> DataFrame:
    """``parts(part int, value binary of int32)`` to ``(part, n, value binary of int64)``: how many there are, and their sum by place."""

    def run(table: pa.Table) -> pa.Table:
        total = 0
        for b in table["value"]:
            total = total + np.frombuffer(b.as_buffer(), np.int32).astype(np.int64)
        return pa.table({"part": table["part"][:1], "n": pa.array([table.num_rows], pa.int64()), "value": pa.array([total.tobytes()], pa.binary())})

    return parts.groupBy("part").applyInArrow(run, "part int, n long, value binary")


def summed(rows: DataFrame, run, names: list[str], by: str) -> pa.Table:
    """Counts that ``run`` yields by task as ``(by, names...)`` arrays of whole numbers, added over all tasks, as ``(by, pos, names...)``."""
    kind = rows.schema[by].dataType.simpleString()
    got = rows.mapInArrow(run, f"{by} {kind}, " + ", ".join(f"{c} array<long>" for c in names))
    one = got.select(by, F.posexplode(F.arrays_zip(*names)).alias("pos", "v")).select(by, "pos", *[F.col(f"v.{c}").alias(c) for c in names])
    return one.groupBy(by, "pos").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
