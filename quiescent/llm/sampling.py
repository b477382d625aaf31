"""Bounded training samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import broadcast_if_small, materialize


def fold(parts: int) -> F.Column:
    """crc32 of the doc_id as text, modulo ``parts``; null for a null id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts))


#: Texts of a sample in all, or one for each value where there are more values.
TOTAL = 19_200


def bounded_sample(rows: DataFrame, texts: DataFrame, by: str, most: int) -> list[tuple[str, object]]:
    """(text, label) of at most ``most`` rows for each value of ``by`` of ``rows(doc_id, by)``.

    No value is left out; with many of them fewer rows of each are taken, down to
    one, so that they are about :data:`TOTAL` in all. The ids with the smallest
    hashes are taken, of rows that share an id the text with the smallest hash, so
    that the same tables give the same sample; only those texts leave the executors.
    """
    h = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(17)), 1)
    rows = rows.where(F.col(by).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", by)
    sizes = materialize(rows.groupBy(by).agg(F.approx_count_distinct("doc_id").alias("n_")), "classes")
    values = sizes.count()
    most = max(1, min(most, TOTAL // max(1, values)))
    # about four times as many as asked for by their hashes alone, so that no task sorts a whole class
    share = h / float(1 << 63) * F.col("n_") < 4.0 * most
    pick = rows.join(broadcast_if_small(sizes, values), by).where(share).select("doc_id", by).distinct()
    pick = pick.withColumn("r_", F.row_number().over(W.partitionBy(by).orderBy(h, "doc_id"))).where(F.col("r_") <= most)
    wanted = broadcast_if_small(pick.select("doc_id", by), most * values)
    got = texts.where(F.col("text").isNotNull()).select("doc_id", "text").join(wanted, "doc_id")
    got = got.groupBy("doc_id", by).agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return sorted(((r["text"], r[by]) for r in got.collect()), key=lambda r: (r[0], str(r[1])))
