"""Recordings of a subject on one timeline, and tables about subjects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import number


def place_recordings(info: DataFrame, srate: float, hours: float = 72.0, subject: str = "sid", ts: str = "ts", name: str = "name", n: str = "nsamples") -> DataFrame:
    """``(subject, name, start, end)`` in samples since the subject's first recording, cut at ``hours``.

    Recordings that start after the cut go.
    """
    w = W.partitionBy(subject)
    first = F.min(ts).over(w)
    start = F.round(F.timestamp_diff("MICROSECOND", first, F.col(ts)) / 1e6 * srate).cast("long")
    most = int(hours * 3600 * srate)
    d = info.withColumn("start", start).where(F.col("start") < most)
    return d.select(subject, name, "start", F.least(F.col("start") + F.col(n), F.lit(most)).cast("long").alias("end"))


def merge_segments(samples: DataFrame, segments: DataFrame, length: int | None, keys: list[str], fill: float | None = 0.0) -> DataFrame:
    """``samples(seg, i, v, keys)`` laid on a timeline by ``segments(seg, start)``: later segments win, gaps are filled.

    Timelines are cut or filled to ``length``; without one each ends with its own last sample.
    """
    t = samples.join(segments.select("seg", F.col("start").alias("s_")), "seg").withColumn("pos", F.col("s_") + F.col("i"))
    t = t.where(F.col("pos").between(1, length) if length else F.col("pos") >= 1)
    top = t.groupBy(*keys, "pos").agg(F.max_by("v", F.struct("s_", "seg")).alias("v"))
    if fill is None:
        return top.withColumnRenamed("pos", "i")
    ends = samples.select(*keys).distinct().withColumn("end_", F.lit(length).cast("long")) if length else top.groupBy(*keys).agg(F.max("pos").alias("end_"))
    grid = ends.select(*keys, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("end_").cast("bigint"))).alias("pos"))
    return grid.join(top, [*keys, "pos"], "left").fillna(fill, ["v"]).withColumnRenamed("pos", "i")


def order_segments(df: DataFrame, subject: str, time: str, name: str) -> DataFrame:
    """Adds the place of a recording by its inner time, then its name, and by its name alone."""
    w = W.partitionBy(subject)
    return df.withColumns({"by_time": F.row_number().over(w.orderBy(time, name)), "by_name": F.row_number().over(w.orderBy(name))})


def unordered(df: DataFrame, subject: str) -> DataFrame:
    """Subjects whose two orders disagree."""
    return df.where("by_time <> by_name").groupBy(subject).agg(F.count("*").alias("n"))


def reliable_time(df: DataFrame, guessed: str, correct: str) -> DataFrame:
    """Recordings whose time was not guessed, or guessed and found right."""
    return df.where(~F.col(guessed) | F.coalesce(F.col(correct), F.lit(False)))


def exclude(df: DataFrame, out: DataFrame, on: str) -> DataFrame:
    return df.join(out.select(on).distinct(), on, "left_anti")


def remaining(todo: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Work that has no finished result yet."""
    return todo.join(done.select(*on).distinct(), on, "left_anti")


def offset_by_name(recordings: DataFrame, offsets: DataFrame, name: str, offset_name: str, offset: str, contains: bool = False) -> DataFrame:
    """Recordings with their offset by equal names, or by the offset table's names that contain theirs.

    Containment has no equality, so the table of offsets, one row for each
    recording known, is broadcast only where it is small.
    """
    if not contains:
        return recordings.join(offsets.select(F.col(offset_name).alias(name), offset), name, "left")
    small = offsets.limit(100_001)
    if small.count() > 100_000:
        raise ValueError("containment takes an offset table of at most 100,000 rows; use equal names")
    j = recordings.join(F.broadcast(offsets.select(F.col(offset_name).alias("on_"), offset)), F.contains(F.col("on_"), F.col(name)), "left")
    return j.withColumn("r_", F.row_number().over(W.partitionBy(name).orderBy(F.length("on_"), "on_"))).where("r_ = 1").drop("r_", "on_")


def with_fallback(df: DataFrame, first: DataFrame, second: DataFrame, on: str, value: str, default: float = 0.0) -> DataFrame:
    """A value from the first table, else from the second, else the default."""
    a, b = first.select(on, F.col(value).alias("a_")), second.select(on, F.col(value).alias("b_"))
    j = df.join(a, on, "left").join(b, on, "left")
    return j.withColumn(value, F.coalesce("a_", "b_", F.lit(default))).drop("a_", "b_")


def outcome_of(subjects: DataFrame, outcomes: DataFrame, on: str = "sid", value: str = "bestCpcBy6Mo", missing: int = -1) -> DataFrame:
    return subjects.join(outcomes.select(on, value), on, "left").withColumn(value, F.coalesce(value, F.lit(missing)))


def sorted_subjects(df: DataFrame, sid: str = "sid") -> DataFrame:
    """Subjects by hospital, then number."""
    return df.select(sid).distinct().orderBy(F.regexp_extract(sid, r"^(\D*)", 1), number(F.col(sid)), sid)


def limit_subjects(df: DataFrame, subject: str, most: int, group: list[str] | None = None, per_group: int | None = None, order: list[str] | None = None) -> DataFrame:
    """The first ``most`` subjects, and of each group the first ``per_group`` rows."""
    d = df.join(df.select(subject).distinct().orderBy(subject).limit(most), subject, "left_semi")
    if per_group:
        d = d.withColumn("r_", F.row_number().over(W.partitionBy(subject, *(group or [])).orderBy(*(order or [subject])))).where(F.col("r_") <= per_group).drop("r_")
    return d


def durations(samples: DataFrame, srate: float, rec: str = "rec_id", channel: str = "channel") -> DataFrame:
    return samples.groupBy(rec).agg(F.max("i").alias("n_samples"), F.count_distinct(channel).cast("int").alias("n_channels")).withColumn("srate", F.lit(srate)).withColumn("seconds", F.col("n_samples") / srate)
