"""Robust referencing: noisy channels, interpolation, and the loop over both."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..params import NoisyChannelParams


def channel_spread(samples: DataFrame, keys: list[str], channel: str = "channel", value: str = "v") -> DataFrame:
    """Adds each channel's robust deviation (0.7413 of its quartile range) and that one's robust score among channels."""
    q = samples.groupBy(*keys, channel).agg((0.7413 * (F.percentile(value, F.lit(0.75)) - F.percentile(value, F.lit(0.25)))).alias("spread"), F.count_if(F.isnan(value) | F.col(value).isNull()).alias("n_nan"), F.stddev_samp(value).alias("sd"))
    w = W.partitionBy(*keys)
    med = F.percentile("spread", F.lit(0.5)).over(w)
    iqr = 0.7413 * (F.percentile("spread", F.lit(0.75)).over(w) - F.percentile("spread", F.lit(0.25)).over(w))
    return q.withColumn("score", (F.col("spread") - med) / F.nullif(iqr, F.lit(0.0)))


def window_correlation(samples: DataFrame, keys: list[str], window: int, channel: str = "channel", idx: str = "i", value: str = "v") -> DataFrame:
    """``(keys, channel, win, max_corr)``: the largest absolute correlation with another channel in each window."""
    d = samples.withColumn("win", F.floor((F.col(idx) - 1) / window))
    d = d.groupBy(*keys, "win", channel).agg(F.array_sort(F.collect_list(F.struct(idx, value))).alias("s")).select(*keys, "win", channel, F.col(f"s.{value}").alias("x"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = min(len(x) for x in pdf["x"])
        m = np.stack([np.asarray(x[:n], float) for x in pdf["x"]])
        with np.errstate(invalid="ignore", divide="ignore"):
            r = np.abs(np.corrcoef(m)) if len(m) > 1 else np.zeros((1, 1))
        r = np.nan_to_num(np.atleast_2d(r))
        np.fill_diagonal(r, 0)
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "win": pdf["win"].iloc[0], channel: pdf[channel].to_numpy(), "max_corr": np.quantile(r, 0.98, axis=1) if len(m) > 2 else r.max(axis=1), "flat": m.std(axis=1) < 1e-10})

    kinds = dict(d.dtypes)
    return d.groupBy(*keys, "win").applyInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"win {kinds['win']}", f"{channel} {kinds[channel]}", "max_corr double", "flat boolean"]))


def noisy_channels(samples: DataFrame, keys: list[str], srate: float, p: NoisyChannelParams | None = None, positions: dict[str, tuple[float, float, float]] | None = None, channel: str = "channel", idx: str = "i", value: str = "v") -> DataFrame:
    """``(keys, channel, bad_nan, bad_deviation, bad_noise, bad_correlation, bad_dropout, bad_ransac, bad)``."""
    p = p or NoisyChannelParams()
    base = channel_spread(samples, keys, channel, value)
    out = base.select(*keys, channel, ((F.col("n_nan") > 0) | (F.coalesce("sd", F.lit(0.0)) < 1e-10)).alias("bad_nan"), (F.abs(F.coalesce("score", F.lit(0.0))) > p.deviation).alias("bad_deviation"))
    # what a 50 Hz low-pass takes away, against what it leaves
    coef = K.fir_sinc(100, min(50.0, 0.45 * srate), srate, "low")

    def ratio(x: np.ndarray) -> dict[str, float]:
        low = K.fir_apply(np.nan_to_num(x), coef)
        mad = lambda v: float(np.median(np.abs(v - np.median(v))))
        return {"noise": mad(np.nan_to_num(x) - low) / max(mad(low), 1e-300)}

    from .signal import per_group

    noise = per_group(samples, [*keys, channel], ratio, ["noise"], idx, value)
    w = W.partitionBy(*keys)
    med = F.percentile("noise", F.lit(0.5)).over(w)
    mad = F.percentile(F.abs(F.col("noise") - F.col("med_")), F.lit(0.5)).over(w) * 1.4826
    noise = noise.withColumn("med_", med).withColumn("mad_", mad)
    noise = noise.select(*keys, channel, F.coalesce((F.col("noise") - F.col("med_")) / F.nullif("mad_", F.lit(0.0)) > p.noise, F.lit(False)).alias("bad_noise"))
    corr = window_correlation(samples, keys, int(p.window_seconds * srate), channel, idx, value)
    corr = corr.groupBy(*keys, channel).agg((F.avg((F.col("max_corr") < p.correlation).cast("int")) > p.bad_fraction).alias("bad_correlation"), (F.avg(F.col("flat").cast("int")) > p.bad_fraction).alias("bad_dropout"))
    out = out.join(noise, [*keys, channel]).join(corr, [*keys, channel])
    if positions:
        out = out.join(ransac(samples, keys, srate, positions, p, channel, idx, value), [*keys, channel], "left").fillna(False, ["bad_ransac"])
    else:
        out = out.withColumn("bad_ransac", F.lit(False))
    flags = ["bad_nan", "bad_deviation", "bad_noise", "bad_correlation", "bad_dropout", "bad_ransac"]
    return out.withColumn("bad", F.greatest(*[F.col(f).cast("int") for f in flags]) == 1)


def ransac(samples: DataFrame, keys: list[str], srate: float, positions: dict[str, tuple[float, float, float]], p: NoisyChannelParams, channel: str = "channel", idx: str = "i", value: str = "v", seed: int = 435656) -> DataFrame:
    """Channels that predictions from random subsets of the others fail to follow in too many windows."""
    window = int(p.ransac_window * srate)
    d = samples.withColumn("win", F.floor((F.col(idx) - 1) / window))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot_table(index=channel, columns=idx, values=value).sort_index()
        names = [c for c in m.index if c in positions]
        x, pos = np.nan_to_num(m.loc[names].to_numpy(float)), np.array([positions[c] for c in names])
        rng = np.random.default_rng(seed)
        k = max(2, int(round(p.ransac_fraction * len(names))))
        pred = []
        for _ in range(p.ransac_samples):
            own = rng.choice(len(names), min(k, len(names)), replace=False)
            pred.append(K.spherical_spline(pos[own], pos) @ x[own])
        y = np.median(pred, axis=0) if pred else x
        a, b = x - x.mean(axis=1, keepdims=True), y - y.mean(axis=1, keepdims=True)
        r = (a * b).sum(axis=1) / np.maximum(np.sqrt((a**2).sum(axis=1) * (b**2).sum(axis=1)), 1e-300)
        return pd.DataFrame({**{c: pdf[c].iloc[0] for c in keys}, channel: names, "low": r < p.ransac_correlation})

    kinds = dict(samples.dtypes)
    r = d.groupBy(*keys, "win").applyInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"{channel} {kinds[channel]}", "low boolean"]))
    return r.groupBy(*keys, channel).agg((F.avg(F.col("low").cast("int")) > p.ransac_unbroken).alias("bad_ransac"))


def interpolate(samples: DataFrame, keys: list[str], bad: list[str], positions: dict[str, tuple[float, float, float]], channel: str = "channel", value: str = "v", idx: str = "i") -> DataFrame:
    """Bad channels from spherical splines of the others: weights are small, sums are in Spark."""
    good = [c for c in positions if c not in bad]
    lost = [c for c in bad if c in positions]
    if not lost:
        return samples
    w = K.spherical_spline(np.array([positions[c] for c in good]), np.array([positions[c] for c in lost]))
    table = samples.sparkSession.createDataFrame([(o, c, float(w[i, j])) for i, o in enumerate(lost) for j, c in enumerate(good)], f"out string, {channel} string, w double")
    new = samples.join(F.broadcast(table), channel).groupBy(*keys, idx, "out").agg(F.sum(F.col("w") * F.col(value)).alias(value)).withColumnRenamed("out", channel)
    return samples.where(~F.col(channel).isin(lost)).unionByName(new.select(samples.columns))


def robust_reference(samples: DataFrame, keys: list[str], srate: float, positions: dict[str, tuple[float, float, float]], p: NoisyChannelParams | None = None, channel: str = "channel", value: str = "v") -> tuple[DataFrame, list[str]]:
    """Referenced samples and the channels found bad. Repeats: reference, find bad channels, interpolate, until no new ones."""
    p = p or NoisyChannelParams()
    bad: list[str] = []
    cur = samples
    for _ in range(p.max_iterations):
        ref = cur.withColumn(value, F.col(value) - F.percentile(value, F.lit(0.5)).over(W.partitionBy(*keys, "i")) if not bad else F.col(value) - F.avg(value).over(W.partitionBy(*keys, "i")))
        # a row for each bad channel of the montage
        found = sorted(r[0] for r in noisy_channels(ref, keys, srate, p, positions, channel).where("bad").select(channel).distinct().collect())
        if set(found) <= set(bad):
            break
        bad = sorted({*bad, *found})
        if len(bad) >= len(positions) - 2:
            break
        cur = interpolate(samples, keys, bad, positions, channel, value)
    mean = F.avg(value).over(W.partitionBy(*keys, "i"))
    return interpolate(samples, keys, bad, positions, channel, value).withColumn(value, F.col(value) - mean), bad


def huber_reference(samples: DataFrame, keys: list[str], chunk: int, channel: str = "channel", idx: str = "i", value: str = "v") -> DataFrame:
    """Less the robust mean over channels at each index, chunk by chunk."""
    d = samples.withColumn("chunk_", F.floor((F.col(idx) - 1) / chunk))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot_table(index=channel, columns=idx, values=value)
        mean = pd.Series(K.huber_mean(m.to_numpy(float)), index=m.columns)
        return pdf.assign(**{value: pdf[value] - pdf[idx].map(mean)}).drop(columns="chunk_")

    return d.groupBy(*keys, "chunk_").applyInPandas(run, samples.schema)


def clean_blocks(samples: DataFrame, keys: list[str], srate: float, block: int, line: tuple[float, ...] = (50.0, 60.0), channel: str = "channel", idx: str = "i", value: str = "v") -> DataFrame:
    """Detrended, line noise removed and average-referenced block by block; a block that fails is zeros with ``ok`` false."""
    d = samples.withColumn("block_", F.floor((F.col(idx) - 1) / block))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot_table(index=channel, columns=idx, values=value)
        ok = True
        try:
            x = m.to_numpy(float)
            if np.isnan(x).any():
                raise ValueError("gaps")
            x = K.linear_detrend(x)
            for f in line:
                if f < srate / 2:
                    x = np.stack([K.remove_line(r, srate, f) for r in x])
            x = x - x.mean(axis=0)
        except (ValueError, np.linalg.LinAlgError):
            x, ok = np.zeros(m.shape), False
        n = m.shape[1]
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, channel: np.repeat(m.index.to_numpy(), n), idx: np.tile(m.columns.to_numpy(), len(m)), value: x.reshape(-1), "ok": ok})

    kinds = dict(samples.dtypes)
    return d.groupBy(*keys, "block_").applyInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"`{channel}` {kinds[channel]}", f"`{idx}` {kinds[idx]}", f"`{value}` double", "ok boolean"]))

