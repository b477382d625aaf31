"""Made-up bursts, points and recordings; the same seed gives the same rows on any number of tasks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _unit(seed: int, *cols: str) -> F.Column:
    """A number in (0, 1) from a hash of columns."""
    return (F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def normal(seed: int, *cols: str) -> F.Column:
    return F.sqrt(-2 * F.ln(_unit(seed, *cols))) * F.cos(2 * math.pi * _unit(seed + 1, *cols))


def bursts(spark: SparkSession, n: int, length: int, srate: float = 200.0, noise: float = 0.1, seed: int = 1) -> DataFrame:
    """``(burst_id, burst_data)``: sinusoids of random amplitude, frequency and phase with noise."""
    d = spark.range(n).withColumnRenamed("id", "burst_id").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
    amp, freq, phase = 0.5 + _unit(seed, "burst_id"), 1 + 9 * _unit(seed + 10, "burst_id"), 2 * math.pi * _unit(seed + 20, "burst_id")
    v = amp * F.sin(2 * math.pi * freq * F.col("i") / srate + phase) + noise * normal(seed + 30, "burst_id", "i")
    return d.withColumn("v", v).groupBy("burst_id").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s")).select("burst_id", F.col("s.v").alias("burst_data"))


def identity_points(spark: SparkSession, dim: int) -> DataFrame:
    """Unit vectors ``(id, vec)``, ids from 1."""
    return spark.range(1, dim + 1).select("id", F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda k: (k == F.col("id")).cast("double")).alias("vec"))


def gaussian_points(spark: SparkSession, n: int, dim: int, seed: int = 1) -> DataFrame:
    d = spark.range(n).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(dim)))).withColumn("x", normal(seed, "id", "k"))
    return d.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("s")).select("id", F.col("s.x").alias("vec"))


def recording(spark: SparkSession, rec_id: str, channels: list[str], seconds: float, srate: float, quiet: float = 10.0, busy: float = 3.0, seed: int = 1) -> DataFrame:
    """``(rec_id, channel, i, v)``: busy stretches between quiet ones, in step over channels."""
    n = int(seconds * srate)
    d = spark.range(1, n + 1).withColumnRenamed("id", "i").withColumn("channel", F.explode(F.array(*[F.lit(c) for c in channels])))
    on = F.pmod(F.col("i") / srate, F.lit(quiet + busy)) >= quiet
    return d.select(F.lit(rec_id).alias("rec_id"), "channel", "i", (F.when(on, 20.0).otherwise(0.2) * normal(seed, "i", "channel")).alias("v"))
