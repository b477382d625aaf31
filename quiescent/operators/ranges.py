"""Index ranges: building, merging, joining and cutting.

Ranges include both ends. Indices are whole numbers; all operators are windows or
equi-joins on bucketed keys, never a join on an inequality alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Indices of a series that are looked at together; ranges that touch the next ones are joined afterwards.
BLOCK = 1 << 16


def index_ranges(df: DataFrame, keys: list[str], idx: str = "i", tol: int = 1) -> DataFrame:
    """Rows' indices to ``(keys, start_idx, end_idx, n)``: a new range starts where the step exceeds ``tol``.

    Ranges are found by blocks of a series; only they are then looked at in order.
    """

    def runs(d: DataFrame, part: list[str], order: list[str], first: str, last: str) -> DataFrame:
        w = W.partitionBy(*part).orderBy(*order)
        new = F.coalesce((F.col(first) - F.lag(last).over(w) > tol).cast("int"), F.lit(0))
        return d.withColumn("new_", new).withColumn("run_", F.sum("new_").over(w))

    own = df.where(F.col(idx).isNotNull()).select(*keys, F.col(idx).alias("i_"), F.floor(F.col(idx) / BLOCK).alias("block_"))
    d = runs(own, [*keys, "block_"], ["i_"], "i_", "i_").groupBy(*keys, "block_", "run_").agg(F.min("i_").alias("start_idx"), F.max("i_").alias("end_idx"), F.count("*").alias("n_"))
    d = runs(d.drop("run_"), keys, ["start_idx"], "start_idx", "end_idx").groupBy(*keys, "run_")
    return d.agg(F.min("start_idx").alias("start_idx"), F.max("end_idx").alias("end_idx"), F.sum("n_").alias("n")).drop("run_")


def merge_regions(df: DataFrame, keys: list[str], start: str = "start_idx", end: str = "end_idx", gap: int = 1) -> DataFrame:
    """Union of overlapping ranges, and of those no more than ``gap`` apart."""
    order = W.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    runs = df.where(F.col(start) <= F.col(end)).withColumn("new_", F.coalesce((F.col(start) > before + gap).cast("int"), F.lit(0)))
    runs = runs.withColumn("run_", F.sum("new_").over(order))
    return runs.groupBy(*keys, "run_").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("run_")


def points_in_ranges(points: DataFrame, ranges: DataFrame, keys: list[str], idx: str = "i", start: str = "start_idx", end: str = "end_idx", bucket: int = 4096, how: str = "inner") -> DataFrame:
    """Pairs of points and the ranges that hold them; ``left_semi`` and ``left_anti`` keep points.

    A range is listed under each bucket of indices it touches, so that the join has
    an equality that holds at most ``bucket`` indices; the exact bounds follow.
    """
    lo, hi = F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket)
    b = ranges.where(F.col(start) <= F.col(end)).withColumn("bucket_", F.explode(F.sequence(lo, hi)))
    p = points.withColumn("bucket_", F.floor(F.col(idx) / bucket))
    clash = {c: f"{c}_r" for c in b.columns if c in points.columns}
    b = b.withColumnsRenamed(clash)
    bucket_b = clash.get("bucket_", "bucket_")
    on = (p["bucket_"] == b[bucket_b]) & (p[idx] >= b[clash.get(start, start)]) & (p[idx] <= b[clash.get(end, end)])
    for k in keys:
        on = on & p[k].eqNullSafe(b[clash.get(k, k)])
    out = p.join(b, on, how)
    drop = ["bucket_"] if how in ("left_semi", "left_anti") else ["bucket_", *(clash.get(k, k) for k in keys)]
    if how not in ("left_semi", "left_anti"):
        return out.drop(p["bucket_"]).drop(b[bucket_b]).drop(*[clash[k] for k in keys if k in clash])
    return out.drop(*drop)


def excise(samples: DataFrame, regions: DataFrame, keys: list[str], idx: str = "i") -> DataFrame:
    """Samples outside the regions; ``idx`` counts them anew from 1 and ``old_`` + ``idx`` has the old index."""
    merged = merge_regions(regions, keys)
    kept = points_in_ranges(samples, merged, keys, idx, how="left_anti").withColumnRenamed(idx, f"old_{idx}")
    part = [c for c in samples.columns if c in (*keys, "channel")]
    return kept.withColumn(idx, F.row_number().over(W.partitionBy(*part).orderBy(f"old_{idx}")).cast("long"))


def boundary_events(regions: DataFrame, keys: list[str]) -> DataFrame:
    """A ``boundary`` event for each removed region, half a sample after what is left before it."""
    merged = merge_regions(regions, keys)
    gone = F.sum(F.col("end_idx") - F.col("start_idx") + 1).over(W.partitionBy(*keys).orderBy("start_idx").rowsBetween(W.unboundedPreceding, -1))
    return merged.select(
        *keys, F.lit("boundary").alias("type"), (F.col("start_idx") - 1 - F.coalesce(gone, F.lit(0)) + 0.5).cast("double").alias("latency"),
        (F.col("end_idx") - F.col("start_idx") + 1).cast("double").alias("duration"),
    )


def shift_events(events: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """Events outside the regions, their latencies less what was removed before them; boundary events are added."""
    merged = merge_regions(regions, keys)
    ev = events.withColumn("at_", F.floor("latency"))
    kept = points_in_ranges(ev, merged, keys, "at_", how="left_anti")
    marks = merged.select(*keys, F.col("start_idx").cast("double").alias("at_"), (F.col("end_idx") - F.col("start_idx") + 1).alias("len_"))
    both = kept.withColumn("len_", F.lit(0).cast("long")).unionByName(marks, allowMissingColumns=True)
    gone = F.sum("len_").over(W.partitionBy(*keys).orderBy("at_").rangeBetween(W.unboundedPreceding, 0))
    moved = both.withColumn("gone_", gone).where("len_ = 0").withColumn("latency", F.col("latency") - F.col("gone_")).drop("at_", "len_", "gone_")
    return moved.unionByName(boundary_events(regions, keys), allowMissingColumns=True)


def windows_around(events: DataFrame, keys: list[str], before: float, after: float, limit: Column | None = None) -> DataFrame:
    """Merged ranges of indices from ``before`` to ``after`` each event's latency, cut at 1 and ``limit``."""
    start = F.greatest(F.lit(1), F.round(F.col("latency") + before)).cast("long")
    end = F.round(F.col("latency") + after).cast("long")
    r = events.select(*keys, start.alias("start_idx"), (F.least(end, limit) if limit is not None else end).alias("end_idx"))
    return merge_regions(r, keys)


def keep_around_events(samples: DataFrame, events: DataFrame, keys: list[str], before: float, after: float, invert: bool = False) -> DataFrame:
    """Samples in (or, inverted, outside) the windows around events."""
    w = windows_around(events, keys, before, after)
    return points_in_ranges(samples, w, keys, how="left_anti" if invert else "left_semi")


def contained_ranges(df: DataFrame, keys: list[str], id_col: str, start: str, end: str, mutual: bool = False) -> DataFrame:
    """Rows whose range lies inside another one's of the same key.

    Of equal ranges the one with the smallest id is not contained; with ``mutual``
    they contain each other. A running maximum of the ends replaces the self-join.
    """
    tie = [F.col(start), F.col(end).desc(), F.col(id_col)]
    order = W.partitionBy(*keys).orderBy(*tie).rowsBetween(W.unboundedPreceding, -1)
    inside = F.coalesce(F.max(end).over(order) >= F.col(end), F.lit(False))
    if mutual:
        inside = inside | (F.count("*").over(W.partitionBy(*keys, start, end)) > 1)
    return df.withColumn("in_", inside).where("in_").drop("in_")
