"""Rejection of trials, epochs and channels by simple statistics.

Long tables ``(keys, trial, channel, t, v)`` in; a row for each trial (and channel)
with its measure and flag out. Second moments are population ones unless said.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def threshold_reject(df: DataFrame, keys: list[str], trial: str, low: float, high: float, value: str = "v") -> DataFrame:
    """``(keys, trial, lo, hi, reject)``: any value outside the limits."""
    g = df.groupBy(*keys, trial).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    return g.withColumn("reject", (F.col("lo") < low) | (F.col("hi") > high))


def central_moments(value: str) -> dict[str, Column]:
    """Sample variance, population skewness and (non-excess) kurtosis; the latter null without spread."""
    spread = F.var_pop(value) > 0
    return {"variance": F.var_samp(value), "skew": F.when(spread, F.skewness(value)), "kurt": F.when(spread, F.kurtosis(value) + 3)}


def epoch_moments(df: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    m = central_moments(value)
    return df.groupBy(*keys).agg(F.count(value).alias("n"), *[e.alias(k) for k, e in m.items()])


def sample_kurtosis(value: str) -> Column:
    """Excess kurtosis with the fourth power of the sample deviation."""
    n = F.count(value)
    pop = (F.kurtosis(value) + 3) * F.pow(F.var_pop(value), 2) / F.pow(F.var_samp(value), 2)
    return F.when(n > 1, pop - 3)


def z_over_trials(df: DataFrame, keys: list[str], measure: str) -> Column:
    """Standard score of a measure among all trials of the keys."""
    w = W.partitionBy(*keys)
    return (F.col(measure) - F.avg(measure).over(w)) / F.nullif(F.stddev_samp(measure).over(w), F.lit(0.0))


def trimmed_scores(df: DataFrame, keys: list[str], measure: str, trim: float, out: str = "z") -> DataFrame:
    """Adds the score of a measure by the mean and deviation of its middle ranks.

    Of ``n`` trials those ranked ``max(1, round(trim n))`` to ``n - round(trim n)`` count.
    """
    w = W.partitionBy(*keys)
    cut = F.round(F.lit(trim) * F.col("n_"))
    d = df.where(F.col(measure).isNotNull()).withColumns({"r_": F.row_number().over(w.orderBy(measure)), "n_": F.count("*").over(w)})
    mid = d.where(F.col("r_").between(F.greatest(cut, F.lit(1)), F.col("n_") - cut)).groupBy(*keys).agg(F.avg(measure).alias("m_"), F.stddev_samp(measure).alias("s_"))
    return df.join(mid, keys, "left").withColumn(out, (F.col(measure) - F.col("m_")) / F.nullif(F.col("s_"), F.lit(0.0))).drop("m_", "s_")


def kurtosis_reject(df: DataFrame, keys: list[str], trial: str, threshold: float, value: str = "v", trim: float = 0.0) -> DataFrame:
    g = df.groupBy(*keys, trial).agg(sample_kurtosis(value).alias("kurt")).where("kurt is not null")
    scored = trimmed_scores(g, keys, "kurt", trim) if trim else g.withColumn("z", z_over_trials(g, keys, "kurt"))
    return scored.withColumn("reject", F.abs("z") > threshold)


def _bin_probability(df: DataFrame, keys: list[str], bins: int, value: str) -> DataFrame:
    """Adds ``p_``: the share of the keys' values in a value's bin."""
    d = df.join(df.groupBy(*keys).agg(F.min(value).alias("lo_"), F.max(value).alias("hi_")), keys)
    b = F.when(F.col("hi_") > F.col("lo_"), F.floor((F.col(value) - F.col("lo_")) / (F.col("hi_") - F.col("lo_")) * (bins - 1)) + 1).otherwise(F.lit(1))
    d = d.withColumn("bin_", b)
    hist = d.groupBy(*keys, "bin_").agg(F.count("*").alias("c_"))
    hist = hist.withColumn("p_", F.col("c_") / F.sum("c_").over(W.partitionBy(*keys))).drop("c_")
    return d.join(hist, [*keys, "bin_"]).drop("lo_", "hi_", "bin_")


def joint_probability_reject(df: DataFrame, keys: list[str], trial: str, threshold: float, bins: int = 1000, value: str = "v") -> DataFrame:
    """``-sum ln p`` of each trial, its score among trials, and whether that is beyond the threshold."""
    g = _bin_probability(df, keys, bins, value).groupBy(*keys, trial).agg((-F.sum(F.ln("p_"))).alias("jp"))
    return g.withColumn("z", z_over_trials(g, keys, "jp")).withColumn("reject", F.abs("z") > threshold)


def entropy_reject(df: DataFrame, keys: list[str], trial: str, threshold: float, bins: int = 1000, value: str = "v") -> DataFrame:
    """``-sum p ln p`` of each trial."""
    g = _bin_probability(df, keys, bins, value).groupBy(*keys, trial).agg((-F.sum(F.col("p_") * F.ln("p_"))).alias("entropy"))
    return g.withColumn("z", z_over_trials(g, keys, "entropy")).withColumn("reject", F.abs("z") > threshold)


#: Fixed value: total variation of a window's samples, for each sample, below which a line never fits well.
LEAST_VARIATION = 1000 * 1.1921e-07


#: Windows up to so many samples have their slope summed sample by sample.
UNROLLED = 16


def _fused(a: float, b: Column) -> tuple[Column, Column]:
    """The product of a number and a column as the nearest double and what that leaves out."""
    ta, tb = a * 134217729.0, b * 134217729.0
    ah, bh = ta - (ta - a), tb - (tb - b)
    p = b * a
    return p, ((bh * ah - p) + (b - bh) * ah + bh * (a - ah)) + (b - bh) * (a - ah)


def _slopes_in_order(g: DataFrame, length: int) -> DataFrame:
    """Replaces ``slope`` of windows with one value ``y1_``, ``y2_``, ... at each place by that of the running moments in order.

    A slope can lie on its limit, so that the last bit decides. The moments are those of
    SQL engines: each product is added unrounded, as a fused multiplication does.
    """
    x_mean, m2 = 0.0, 0.0
    d = g.withColumns({"m0_": F.lit(0.0), "c0_": F.lit(0.0)})
    for n in range(1, length + 1):
        dx = n - x_mean
        x_mean += dx / n
        m2 += dx * (n - x_mean)
        y, m, c = F.col(f"y{n}_"), F.col(f"m{n - 1}_"), F.col(f"c{n - 1}_")
        # a step each, so that no expression holds another twice
        d = d.withColumn(f"m{n}_", m + (y - m) / n).withColumn("r_", y - F.col(f"m{n}_"))
        product, rest = _fused(dx, F.col("r_"))
        d = d.withColumns({"p_": product, "e_": rest}).withColumn("s_", F.col("p_") + c).withColumn("b_", F.col("s_") - F.col("p_"))
        d = d.withColumn(f"c{n}_", F.col("s_") + ((F.col("p_") - (F.col("s_") - F.col("b_"))) + (c - F.col("b_")) + F.col("e_")))
    own = F.col(f"c{length}_") / length / F.lit(m2 / length)
    return d.withColumn("slope", F.when(F.col("n_") == length, F.coalesce(own, "slope")).otherwise(F.col("slope"))).select(*g.columns)


def trend_reject(df: DataFrame, keys: list[str], trial: str, length: int, step: int, max_slope: float, min_r2: float, t: str = "t", value: str = "v") -> DataFrame:
    """Trials with a window whose line is at least as steep as ``max_slope`` and fits better than ``min_r2``.

    ``max_slope`` is the rise over a window. Windows start ``step`` apart from t = 1
    and must be complete. The fit is one less the share of the variation that the
    line leaves, which in a nearly flat window is a share of :data:`LEAST_VARIATION`.
    Short windows' slopes are summed in order of time, whatever order rows come in.
    """
    first = F.greatest(F.lit(0), F.ceil((F.col(t) - length) / step))
    d = df.withColumn("w_", F.explode(F.sequence(first.cast("int"), F.floor((F.col(t) - 1) / step).cast("int"))))
    d = d.withColumn("x_", F.col(t) - F.col("w_") * step).where(F.col("x_").between(1, length))
    places = [F.max(F.when(F.col("x_") == k, F.col(value).cast("double"))).alias(f"y{k}_") for k in range(1, length + 1)] if 1 < length <= UNROLLED else []
    g = d.groupBy(*keys, trial, "w_").agg(F.regr_slope(value, "x_").alias("slope"), F.coalesce(F.regr_r2(value, "x_"), F.lit(0.0)).alias("r2"), (F.var_pop(value) * length).alias("sst_"), F.count("*").alias("n_"), *places)
    if places:
        g = _slopes_in_order(g, length)
    fit = 1 - F.col("sst_") * (1 - F.col("r2")) / F.greatest(F.col("sst_"), F.lit(LEAST_VARIATION * length))
    g = g.where(F.col("n_") == length).withColumn("hit", (F.abs(F.col("slope") * length) >= max_slope) & (fit > min_r2))
    return g.groupBy(*keys, trial).agg(F.max(F.abs("slope")).alias("max_slope"), F.bool_or("hit").alias("reject"))


def population_outliers(stats: DataFrame, measure: str, n_sd: float, skip_zero: bool = False, floor: float | None = None) -> DataFrame:
    """Rows with whether a measure lies beyond ``n_sd`` deviations of all rows; zeros can be left out of the statistics, and a floor added."""
    use = F.when(F.col(measure) != 0, F.col(measure)) if skip_zero else F.col(measure)
    pop = stats.agg(F.avg(use).alias("pop_mean"), F.stddev_samp(use).alias("pop_sd"))
    out = stats.join(F.broadcast(pop))
    bad = F.abs(F.col(measure) - F.col("pop_mean")) > n_sd * F.col("pop_sd")
    if floor is not None:
        bad = bad | (F.col(measure) < floor)
    return out.withColumn("outlier", bad)


def band_power_outliers(stats: DataFrame, power: str, low_factor: float, high_factor: float) -> DataFrame:
    """Rows with whether a power is under ``low_factor`` or over ``high_factor`` times the mean of all: ``10^(dB/10)``."""
    pop = stats.agg(F.avg(power).alias("pop_mean"))
    out = stats.join(F.broadcast(pop))
    return out.withColumn("outlier", (F.col(power) < low_factor * F.col("pop_mean")) | (F.col(power) > high_factor * F.col("pop_mean")))


def dirty_fraction(epochs: DataFrame, keys: list[str], flags: list[str], per: int, epoch: str = "epoch") -> DataFrame:
    """Share of epochs with any flag in each group of ``per`` epochs."""
    dirty = reduce(lambda a, b: a | b, [F.coalesce(F.col(f), F.lit(False)) for f in flags])
    return epochs.groupBy(*keys, F.floor((F.col(epoch) - 1) / per).alias("block")).agg(F.avg(dirty.cast("int")).alias("dirty"))


def any_flag(df: DataFrame, flags: list[str], out: str = "reject") -> DataFrame:
    return df.withColumn(out, reduce(lambda a, b: a | b, [F.coalesce(F.col(f), F.lit(False)) for f in flags]))


def drop_rejected(trials: DataFrame, flagged: DataFrame, keys: list[str], trial: str) -> DataFrame:
    """Trials that are not flagged, numbered anew from 1."""
    bad = flagged.where("reject").select(*keys, trial).distinct()
    left = trials.join(bad, [*keys, trial], "left_anti")
    return left.withColumn(f"new_{trial}", F.dense_rank().over(W.partitionBy(*keys).orderBy(trial)))


def spectrum_reject(psd: DataFrame, keys: list[str], trial: str, lo: float, hi: float, low_db: float, high_db: float) -> DataFrame:
    """Trials whose decibels, less the mean spectrum of all trials, leave the limits at some frequency of the band."""
    w = W.partitionBy(*keys, "freq")
    d = psd.where(F.col("freq").between(lo, hi)).withColumn("db", 10 * F.log10("power"))
    d = d.withColumn("rel", F.col("db") - F.avg("db").over(w))
    g = d.groupBy(*keys, trial).agg(F.min("rel").alias("lo"), F.max("rel").alias("hi"))
    return g.withColumn("reject", (F.col("lo") < low_db) | (F.col("hi") > high_db))


def robust_score(df: DataFrame, keys: list[str], measure: str) -> Column:
    """``(x - median) / (0.7413 IQR)`` among the rows of the keys; null without spread."""
    w = W.partitionBy(*keys)
    med = F.percentile(measure, F.lit(0.5)).over(w)
    iqr = F.percentile(measure, F.lit(0.75)).over(w) - F.percentile(measure, F.lit(0.25)).over(w)
    return (F.col(measure) - med) / F.nullif(iqr * 0.7413, F.lit(0.0))


def mad(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median and median absolute deviation, by two passes."""
    med = df.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("med"))
    j = df.join(med, keys) if keys else df.join(F.broadcast(med))
    return j.groupBy(*keys).agg(F.first("med").alias("med"), F.percentile(F.abs(F.col(value) - F.col("med")), F.lit(0.5)).alias("mad"))


def quality_issues(checks: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """``(keys, issues)``: names of the rules that a row breaks, for rows that break any."""
    named = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return checks.select(*keys, named.alias("issues")).where(F.size("issues") > 0)
