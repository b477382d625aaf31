"""Averages over epochs and datasets, and comparisons of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def evoked(epochs: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """Mean, deviation and count at each key: the average over epochs."""
    return epochs.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))


def grand_average(epochs: DataFrame, dataset: str, keys: Sequence[str], value: str = "v") -> DataFrame:
    """Mean of the datasets' own averages: each dataset counts once."""
    own = evoked(epochs, [dataset, *keys], value)
    return own.groupBy(*keys).agg(F.avg("mean").alias("mean"), F.stddev_samp("mean").alias("sd"), F.count("*").alias("n"))


def compare_conditions(epochs: DataFrame, dataset: str, condition: str, a: object, b: object, keys: Sequence[str], value: str = "v") -> DataFrame:
    """Averages of two conditions over datasets, their difference and its paired t."""
    own = evoked(epochs.where(F.col(condition).isin(a, b)), [dataset, condition, *keys], value)
    pair = own.groupBy(dataset, *keys).agg(F.max(F.when(F.col(condition) == a, F.col("mean"))).alias("a_"), F.max(F.when(F.col(condition) == b, F.col("mean"))).alias("b_"))
    d = F.col("a_") - F.col("b_")
    n = F.count(d)
    return pair.groupBy(*keys).agg(
        F.avg("a_").alias("mean_a"), F.avg("b_").alias("mean_b"), F.avg(d).alias("difference"), F.stddev_samp(d).alias("sd"),
        (F.avg(d) / F.nullif(F.stddev_samp(d), F.lit(0.0)) * F.sqrt(n)).alias("t_stat"), n.alias("n"),
    )


def block_average(samples: DataFrame, keys: Sequence[str], frames: int, weights: DataFrame | None = None, idx: str = "i", value: str = "v") -> DataFrame:
    """``(keys, t, v)``: weighted mean over epochs laid end to end, ``weights(epoch, w)`` being 1 by default and needing no given sum."""
    d = samples.withColumns({"epoch": F.floor((F.col(idx) - 1) / frames) + 1, "t": (F.col(idx) - 1) % frames + 1})
    d = d.join(weights, "epoch") if weights is not None else d.withColumn("w", F.lit(1.0))
    return d.groupBy(*keys, "t").agg((F.sum(F.col("w") * F.col(value)) / F.nullif(F.sum("w"), F.lit(0.0))).alias("v"))


def event_correlation(epochs: DataFrame, keys: Sequence[str], event_value: str, value: str = "v") -> DataFrame:
    """Correlation of a number of the events with the data at each key, over epochs."""
    return epochs.groupBy(*keys).agg(F.corr(event_value, value).alias("r"), F.count("*").alias("n"))


def order_by_variance(components: DataFrame, keys: Sequence[str], component: str, value: str = "v") -> DataFrame:
    """Components with their variance and rank, the largest first."""
    g = components.groupBy(*keys, component).agg(F.var_samp(value).alias("variance"))
    return g.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("variance"), component)))


def slowest_then_median(df: DataFrame, query: str, worker: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Median over queries of the largest value among workers."""
    top = df.groupBy(*keys, query).agg(F.max(value).alias("top"), F.count_distinct(worker).alias("workers"))
    return top.groupBy(*keys).agg(F.percentile("top", F.lit(0.5)).alias("median"), F.max("workers").alias("workers"), F.count("*").alias("n"))


def speed_up(n_points: Column, comparisons: Column, workers: Column) -> Column:
    """How many times fewer comparisons each worker makes than a full scan."""
    return n_points / F.nullif(comparisons, F.lit(0)) / workers


def noisy_summary(flags: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """How many channels each test found, and all tests together."""
    return flags.groupBy(*keys).agg(F.count("*").alias("channels"), *[F.sum(F.col(n).cast("long")).alias(n) for n in names])
