"""Exponential moving mean and variance, and what is built on it.

The recursion ``mu_i = b mu_(i-1) + (1 - b) x_i`` is an affine map of the state, so
blocks of samples are composed on their own: their end maps are folded per series,
and inside a block the state is a weighted running sum. Blocks are the unit of
parallel work, however long a recording is.
"""

from __future__ import annotations

import math
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Least samples of a block of a series.
MARGIN = 1 << 16


def _block_size(beta: float, most: int = 256) -> int:
    """Largest block whose inverse weights stay well inside a double."""
    return max(1, min(most, int(100 * math.log(10) / max(1e-9, -math.log(beta)))))


def _scan(df: DataFrame, keys: list[str], idx: str, value: Column, first: Column, beta: float, out: str) -> DataFrame:
    """``out_i = b out_(i-1) + (1 - b) value_i``, from ``first`` before the first sample. Adds ``block_`` and ``at_``."""
    size = _block_size(beta)
    b = df.withColumns({"block_": F.floor((F.col(idx) - 1) / size), "at_": ((F.col(idx) - 1) % size).cast("int"), "x_": value})
    total = F.sum(F.lit(1 - beta) * F.col("x_") * F.pow(F.lit(beta), F.lit(-1.0) * F.col("at_")))
    ends = b.groupBy(*keys, "block_").agg(F.max("at_").alias("last_"), total.alias("sum_"), F.min_by(first, idx).alias("first_"))
    ends = ends.withColumn("map_", F.struct(F.pow(F.lit(beta), F.col("last_") + 1).alias("a"), (F.col("sum_") * F.pow(F.lit(beta), F.col("last_"))).alias("add")))
    # after so many blocks nothing of a state is left in a double
    reach = max(1, math.ceil(50 / max(1e-9, -size * math.log(beta)))) if beta > 0 else 1
    order = W.partitionBy(*keys).orderBy("block_")
    ends = ends.withColumns({
        "before_": F.collect_list("map_").over(order.rowsBetween(-reach, -1)), "first_": F.first("first_").over(order.rowsBetween(W.unboundedPreceding, 0)),
        "k_": F.row_number().over(order),
    })
    start = F.aggregate("before_", F.when(F.col("k_") <= reach + 1, F.col("first_").cast("double")).otherwise(F.lit(0.0)), lambda m, x: m * x["a"] + x["add"])
    starts = ends.select(*keys, "block_", start.alias("start_"))
    run = F.sum(F.col("x_") * F.pow(F.lit(beta), F.lit(-1.0) * F.col("at_"))).over(W.partitionBy(*keys, "block_").orderBy(idx))
    j = b.join(starts, [*keys, "block_"])
    return j.withColumn(out, F.pow(F.lit(beta), F.col("at_") + 1) * F.col("start_") + F.lit(1 - beta) * F.pow(F.lit(beta), F.col("at_")) * run).drop("block_", "at_", "x_", "start_")


def ema_variance(df: DataFrame, keys: list[str], idx: str = "i", value: str = "v", beta: float = 0.95) -> DataFrame:
    """Adds ``mu`` and ``var``; the mean starts at the first sample, the variance at 0 and uses the mean already updated.

    ``idx`` counts each series from 1 without gaps.
    """
    x = F.col(value).cast("double")
    m = _scan(df, keys, idx, x, x, beta, "mu")
    return _scan(m, keys, idx, (x - F.col("mu")) * (x - F.col("mu")), F.lit(0.0), beta, "var")


def ema_variance_array(values: Column, beta: float) -> Column:
    """Variances of an ordered array of samples, in one fold: for short series."""
    start = F.struct(values[0].cast("double").alias("mu"), F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("o"))

    def step(st: Column, x: Column) -> Column:
        mu = F.lit(beta) * st["mu"] + F.lit(1 - beta) * x
        s = F.lit(beta) * st["s"] + F.lit(1 - beta) * (x - mu) * (x - mu)
        return F.struct(mu.alias("mu"), s.alias("s"), F.array_append(st["o"], s).alias("o"))

    return F.aggregate(values, start, step, lambda st: st["o"])


def ema_variance_kernel(x: np.ndarray, beta: float, mu: float | None = None, var: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(means, variances) of one series, from a state if one is given.

    All blocks are multiplied by one triangular matrix at once; only a number for
    each block is carried on one by one.
    """
    if not len(x):
        return np.zeros(0), np.zeros(0)
    size = _block_size(beta, 64)
    k = np.arange(size)
    lower = np.where(k[:, None] >= k, (1 - beta) * beta ** np.abs(k[:, None] - k), 0.0)
    fade = beta ** (k + 1.0)

    def scan(v: np.ndarray, s: float) -> np.ndarray:
        n = -(-len(v) // size)
        full = np.zeros(n * size)
        full[: len(v)] = v
        out = full.reshape(n, size) @ lower.T
        start, step = np.empty(n), float(fade[-1])
        for j, e in enumerate(out[:, -1].tolist()):
            start[j] = s
            s = step * s + e
        out += start[:, None] * fade
        return out.reshape(-1)[: len(v)]

    x = x.astype(float)
    m = scan(x, float(x[0]) if mu is None else mu)
    return m, scan((x - m) ** 2, var)


def ema_variance_grouped(df: DataFrame, keys: list[str], idx: str, value: str, beta: float) -> DataFrame:
    """As :func:`ema_variance`, a whole series in one task; for series that fit one."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(idx)
        mu, var = ema_variance_kernel(pdf[value].to_numpy(), beta)
        return pdf.assign(mu=mu, var=var)

    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.groupBy(*keys).applyInPandas(run, f"{fields}, mu double, var double")


def _with_margin(df: DataFrame, keys: list[str], idx: str, before: int, after: int) -> tuple[DataFrame, list[str]]:
    """Rows in blocks of indices, each with the ``before`` rows ahead of it and the ``after`` behind; and the columns that part them.

    ``own_`` marks a block's own rows. However long a series is, a block is sorted at a time.
    """
    size = max(MARGIN, 8 * (before + after))
    at, block = F.pmod(F.col(idx) - 1, F.lit(size)), F.floor((F.col(idx) - 1) / size)
    near = [F.lit(0)]
    if before:
        near.append(F.when(at >= size - before, F.lit(1)))
    if after:
        near.append(F.when(at < after, F.lit(-1)))
    d = df.withColumn("d_", F.explode(F.filter(F.array(*near), lambda x: x.isNotNull())))
    return d.withColumns({"block_": block + F.col("d_"), "own_": F.col("d_") == 0}).drop("d_"), [*keys, "block_"]


def suppression_ratio(df: DataFrame, keys: list[str], window: int, idx: str = "i", z: str = "z", artifact: str | None = None) -> DataFrame:
    """Adds ``bsr``: the share of z = 0 in the trailing ``window`` samples, fewer at the start; null where one is an artifact.

    ``idx`` counts each series from 1 without gaps. Differences of running sums in
    blocks of the series instead of a frame that is summed anew for each row.
    """
    d, part = _with_margin(df, keys, idx, window, 0)
    order = W.partitionBy(*part).orderBy(idx)
    art = F.col(artifact).cast("int") if artifact else F.lit(0)
    d = d.withColumns({"cz_": F.sum(z).over(order), "ca_": F.sum(art).over(order)})
    inside = F.col("cz_") - F.coalesce(F.lag("cz_", window).over(order), F.lit(0))
    bad = F.col("ca_") - F.coalesce(F.lag("ca_", window).over(order), F.lit(0))
    n = F.least(F.col(idx), F.lit(window))
    return d.withColumn("bsr", F.when(bad == 0, 1 - inside / n)).where("own_").drop("cz_", "ca_", "own_", "block_")


def relabel_short_quiet(df: DataFrame, keys: list[str], at_least: int, idx: str = "i", z: str = "z") -> DataFrame:
    """Runs of z = 0 shorter than ``at_least`` become 1. ``idx`` counts each series without gaps."""
    # a run that leaves the margin has at least so many rows inside it
    d, part = _with_margin(df, keys, idx, at_least, at_least)
    d = d.withColumn("run_", F.col(idx) - F.row_number().over(W.partitionBy(*part, z).orderBy(idx)))
    size = F.count("*").over(W.partitionBy(*part, z, "run_"))
    return d.withColumn("z_", F.when((F.col(z) == 0) & (size < at_least), F.lit(1)).otherwise(F.col(z))).where("own_").drop("run_", "own_", "block_", z).withColumnRenamed("z_", z).select(*df.columns)


def fill_gaps_kernel(x: np.ndarray) -> np.ndarray:
    """NaN gaps filled by copies of what stands before and, where that is too short, after them.

    A gap no longer than the run before it repeats that run's end. One no longer
    than both runs takes all of the run before and then the start of the one after.
    A longer one repeats the run before, then a remainder of both, then the run after.
    """
    y = np.array(x, float)
    ok = ~np.isnan(y)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (~ok).astype(np.int8), [0]])))
    for k in range(0, len(edges), 2):
        s, e = edges[k], edges[k + 1]
        gap = e - s
        front = y[: s][-(s - (edges[k - 1] if k else 0)) :] if s else y[:0]
        stop = edges[k + 2] if k + 2 < len(edges) else len(y)
        back = y[e:stop]
        if gap <= len(front):
            y[s:e] = front[len(front) - gap :]
        elif gap <= len(front) + len(back):
            y[s:e] = np.concatenate([front, back[: gap - len(front)]])
        elif len(front) + len(back):
            both = np.concatenate([front, back])
            times, rest = divmod(gap, len(both))
            y[s:e] = np.concatenate([np.tile(front, times), both[:rest], np.tile(back, times)])
    return y


def last_known(df: DataFrame, keys: list[str], idx: str, value: str, out: str) -> DataFrame:
    """Nulls and NaN replaced by the last value before them."""
    order = W.partitionBy(*keys).orderBy(idx).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(out, F.last(F.when(~F.isnan(value), F.col(value)), ignorenulls=True).over(order))


def moving_average(df: DataFrame, keys: list[str], x: str, value: str, half_width: float, out: str = "avg") -> DataFrame:
    """Mean of the values whose ``x`` is within ``half_width``, on irregular ``x``."""
    order = W.partitionBy(*keys).orderBy(x).rangeBetween(-half_width, half_width)
    return df.withColumn(out, F.avg(value).over(order))


def weighted_moving_average(df: DataFrame, keys: list[str], x: str, value: str, width: float, advance: float, weights: np.ndarray) -> DataFrame:
    """``(keys, x, avg)`` at a grid ``advance`` apart; weights are spread over the window of ``width``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(x)
        xs, vs = pdf[x].to_numpy(float), pdf[value].to_numpy(float)
        grid = np.arange(xs[0] + width / 2, xs[-1] - width / 2 + 1e-9, advance) if len(xs) else np.zeros(0)
        lo, hi = np.searchsorted(xs, grid - width / 2), np.searchsorted(xs, grid + width / 2, side="right")
        avg = np.full(len(grid), np.nan)
        for k, (a, b) in enumerate(zip(lo, hi, strict=True)):
            if b > a:
                at = np.clip(((xs[a:b] - grid[k] + width / 2) / width * (len(weights) - 1)).round().astype(int), 0, len(weights) - 1)
                avg[k] = np.average(vs[a:b], weights=weights[at]) if weights[at].sum() else np.nan
        return pd.DataFrame({**{c: pdf[c].iloc[0] for c in keys}, x: grid, "avg": avg})

    kinds = dict(df.dtypes)
    return df.groupBy(*keys).applyInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"`{x}` double", "avg double"]))


def fill_gaps(df: DataFrame, keys: list[str], idx: str, value: str) -> DataFrame:
    """:func:`fill_gaps_kernel` of each series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(idx)
        return pdf.assign(**{value: fill_gaps_kernel(pdf[value].to_numpy(float))})

    return df.groupBy(*keys).applyInPandas(run, df.schema)

