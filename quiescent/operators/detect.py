"""From samples to episodes and bursts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..params import DetectParams
from .ranges import index_ranges, points_in_ranges
from .recursive import ema_variance, relabel_short_quiet, suppression_ratio


def with_index(df: DataFrame, keys: list[str], order: list[str], out: str = "i") -> DataFrame:
    """Numbers each series from 1."""
    return df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long"))


def local_labels(samples: DataFrame, keys: list[str], beta: float, threshold: float, idx: str = "i", value: str = "v") -> DataFrame:
    """Adds ``z``: 1 where the moving variance exceeds the threshold."""
    return ema_variance(samples, keys, idx, value, beta).withColumn("z", (F.col("var") > threshold).cast("int"))


def channel_vote(labels: DataFrame, keys: list[str], n_channels: int, z: str = "z", agree: float = 0.6) -> DataFrame:
    """Joint label by ``keys``: 1 if at least the agreed share of valid channels has 1.

    With more than three channels three must be valid, with fewer exactly two; a
    label is null where too few are.
    """
    g = labels.groupBy(*keys).agg(F.sum(z).alias("on"), F.count(z).alias("valid"))
    enough = F.col("on") >= F.ceil(F.col("valid") * agree)
    if n_channels > 3:
        out = F.when(F.col("valid") >= 3, (enough).cast("int"))
    else:
        out = F.when(F.col("valid") > 0, (enough & (F.col("valid") == 2)).cast("int"))
    return g.withColumn("z", out).drop("on")


def artifact_chunks(samples: DataFrame, keys: list[str], chunk: int, saturation: float, min_std: float, idx: str = "i", value: str = "v", channel: str = "channel", muscle: str | None = None, muscle_std: float = 5.0) -> DataFrame:
    """``(keys, chunk, is_artifact)`` of half-open chunks: any channel saturated or flat.

    The channel ``muscle`` is judged by another rule: its deviation exceeds ``muscle_std``.
    """
    by = samples.groupBy(*keys, channel, F.floor((F.col(idx) - 1) / chunk).alias("chunk"))
    ch = by.agg(F.max(F.abs(value)).alias("peak"), F.stddev_samp(value).alias("sd"))
    bad = (F.col("peak") > saturation) | F.coalesce(F.col("sd") < min_std, F.lit(False))
    if muscle is not None:
        bad = F.when(F.col(channel) == muscle, F.coalesce(F.col("sd") > muscle_std, F.lit(False))).otherwise(bad)
    return ch.groupBy(*keys, "chunk").agg(F.bool_or(bad).alias("is_artifact"))


def ratio_band(df: DataFrame, low: float, high: float, ratio: str = "bsr") -> DataFrame:
    """Rows whose ratio lies strictly inside the band."""
    return df.where((F.col(ratio) > low) & (F.col(ratio) < high))


def episodes(df: DataFrame, keys: list[str], low: float, high: float, gap: int, min_span: int, idx: str = "i", shift: int = 0) -> DataFrame:
    """``(keys, start_idx, end_idx, n)`` of rows in the ratio band; ranges shorter than ``min_span`` go.

    ``shift`` moves starts back, not below 1.
    """
    r = index_ranges(ratio_band(df, low, high), keys, idx, gap)
    if shift:
        r = r.withColumn("start_idx", F.greatest(F.lit(1), F.col("start_idx") - shift))
    return r.where(F.col("end_idx") - F.col("start_idx") >= min_span)


def bursts(labels: DataFrame, eps: DataFrame, keys: list[str], tol: int, idx: str = "i", z: str = "z") -> DataFrame:
    """Ranges of z = 1 inside each episode: ``(keys, episode_start, episode_end, start_idx, end_idx, n)``."""
    e = eps.select(*keys, F.col("start_idx").alias("episode_start"), F.col("end_idx").alias("episode_end"))
    on = points_in_ranges(labels.where(F.col(z) == 1).select(*keys, idx), e, keys, idx, "episode_start", "episode_end")
    return index_ranges(on, [*keys, "episode_start", "episode_end"], idx, tol)


def number_ranges(df: DataFrame, keys: list[str], out: str, start: str = "start_idx") -> DataFrame:
    """Adds the rank of a range among those of its key, from 1."""
    return df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(start)))


def long_enough(df: DataFrame, least: int, most: int | None = None) -> DataFrame:
    """Ranges of ``least`` to ``most`` samples, both ends counted."""
    n = F.col("end_idx") - F.col("start_idx") + 1
    return df.where(n.between(least, most) if most is not None else n >= least)


def detect(samples: DataFrame, p: DetectParams, artifacts: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``samples(rec_id, channel, i, v)`` to joint labels with ratios, episodes and bursts.

    ``artifacts(rec_id, i)`` lists samples that make a ratio undefined.
    """
    n = samples.select("channel").distinct().count()
    local = local_labels(samples, ["rec_id", "channel"], p.beta, p.variance_threshold)
    joint = channel_vote(local, ["rec_id", "i"], n, agree=p.agree_fraction).withColumn("z", F.coalesce("z", F.lit(0)))
    joint = relabel_short_quiet(joint, ["rec_id"], int(p.min_quiet_time * p.srate))
    if artifacts is not None:
        joint = joint.join(artifacts.select("rec_id", "i", F.lit(1).alias("art")), ["rec_id", "i"], "left").fillna(0, ["art"])
    ratio = suppression_ratio(joint, ["rec_id"], int(p.ratio_window * p.srate), artifact="art" if artifacts is not None else None)
    eps = episodes(ratio, ["rec_id"], p.ratio_low, p.ratio_high, int(p.episode_gap * p.srate), int(p.min_episode * p.srate), shift=int(p.ratio_window) if p.shift_start else 0)
    return ratio, eps, bursts(ratio, eps, ["rec_id"], p.burst_gap)
