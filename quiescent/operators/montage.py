"""Channels: standard names, montages, references, geometry and combinations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .sourcespace import nearest_points

#: The nineteen electrodes of the international 10-20 system.
MASTER = ("Fp1", "F3", "C3", "P3", "O1", "F7", "T3", "T5", "Fz", "Cz", "Pz", "Fp2", "F4", "C4", "P4", "O2", "F8", "T4", "T6")
#: Newer names of four of them.
RENAMED = {"T7": "T3", "T8": "T4", "P7": "T5", "P8": "T6"}
#: Pairs of the longitudinal bipolar montage.
BIPOLAR = (
    ("Fp1", "F7"), ("F7", "T3"), ("T3", "T5"), ("T5", "O1"), ("Fp2", "F8"), ("F8", "T4"), ("T4", "T6"), ("T6", "O2"), ("Fp1", "F3"),
    ("F3", "C3"), ("C3", "P3"), ("P3", "O1"), ("Fp2", "F4"), ("F4", "C4"), ("C4", "P4"), ("P4", "O2"), ("Fz", "Cz"), ("Cz", "Pz"),
)


#: Names without prefix and reference to the channel they stand for.
LABELS = {c.lower(): c for c in MASTER} | {k.lower(): v for k, v in RENAMED.items()}


def standard_label(label: Column) -> Column:
    """Name of a master channel without prefix and reference (``EEG Fp1-Ref``), older name; null for others."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(label)), r"^eeg\s+", ""), r"-ref\d*$", "")
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair]), bare)


def standardize_channels(samples: DataFrame, keys: Sequence[str] = ("rec_id",), channel: str = "channel") -> DataFrame:
    """The nineteen master channels at every index, with their place in ``idx``; missing ones are 0, others go."""
    named = samples.withColumn(channel, standard_label(F.col(channel))).where(F.col(channel).isNotNull())
    grid = named.select(*keys, "i").distinct()
    full = grid.withColumn("m_", F.explode(F.array(*[F.struct(F.lit(i + 1).alias("idx"), F.lit(c).alias(channel)) for i, c in enumerate(MASTER)])))
    full = full.select(*keys, "i", "m_.idx", f"m_.{channel}")
    return full.join(named.select(*keys, "i", channel, "v"), [*keys, "i", channel], "left").fillna(0.0, ["v"])


def bipolar(samples: DataFrame, keys: Sequence[str] = ("rec_id", "i"), pairs: Sequence[tuple[str, str]] = BIPOLAR, channel: str = "channel", value: str = "v") -> DataFrame:
    """Channel differences ``a-b`` at each index, from one conditional aggregation; pairs that lack a channel are null."""
    names = sorted({c for p in pairs for c in p})
    wide = samples.groupBy(*keys).agg(*[F.max(F.when(F.col(channel) == c, F.col(value))).alias(f"c_{c}") for c in names])
    rows = F.array(*[F.struct(F.lit(f"{a}-{b}").alias("channel"), (F.col(f"c_{a}") - F.col(f"c_{b}")).alias("v")) for a, b in pairs])
    return wide.select(*keys, F.explode(rows).alias("r")).select(*keys, F.col("r.channel").alias(channel), F.col("r.v").alias(value))


def invert_sites(samples: DataFrame, sites: Sequence[str] = ("ynh", "bwh"), path: str = "path", value: str = "v") -> DataFrame:
    """Values of recordings whose path names one of the sites change sign."""
    hit = F.lit(False)
    for s in sites:
        hit = hit | F.contains(F.lower(path), F.lit(s))
    return samples.withColumn(value, F.when(hit, -F.col(value)).otherwise(F.col(value)))


def average_reference(samples: DataFrame, keys: Sequence[str], exclude: Sequence[str] = (), channel: str = "channel", value: str = "v", out: str = "v") -> DataFrame:
    """Less the mean over channels at each index; excluded channels neither count nor change."""
    inside = ~F.col(channel).isin(list(exclude)) if exclude else F.lit(True)
    ref = F.avg(F.when(inside, F.col(value))).over(W.partitionBy(*keys))
    return samples.withColumn(out, F.when(inside, F.col(value) - ref).otherwise(F.col(value)))


def common_reference(samples: DataFrame, keys: Sequence[str], refs: Sequence[str], keep: bool = False, channel: str = "channel", value: str = "v") -> DataFrame:
    """Less the mean of the reference channels, which go unless kept."""
    ref = F.avg(F.when(F.col(channel).isin(list(refs)), F.col(value))).over(W.partitionBy(*keys))
    out = samples.withColumn(value, F.col(value) - ref)
    return out if keep else out.where(~F.col(channel).isin(list(refs)))


def remove_baseline(samples: DataFrame, keys: Sequence[str], lo: int | None = None, hi: int | None = None, t: str = "t", value: str = "v", out: str = "v") -> DataFrame:
    """Less the mean of each key over a stretch of ``t``, all of it by default; NaN does not count."""
    inside = F.lit(True) if lo is None else F.col(t).between(lo, hi)
    base = F.avg(F.when(inside & ~F.isnan(F.col(value).cast("double")), F.col(value))).over(W.partitionBy(*keys))
    return samples.withColumn(out, F.col(value) - base)


def envelope(samples: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    return samples.groupBy(*keys).agg(F.max(value).alias("upper"), F.min(value).alias("lower"))


def combine(samples: DataFrame, weights: DataFrame, keys: Sequence[str], channel: str = "channel", value: str = "v") -> DataFrame:
    """Weighted sums ``weights(out, channel, w)`` of channels at each index: activations, projections, interpolation."""
    j = samples.join(F.broadcast(weights), channel)  # a matrix of channels by channels
    return j.groupBy(*keys, "out").agg(F.sum(F.col("w") * F.col(value)).alias(value))


def weight_table(spark: SparkSession, m: np.ndarray, outs: Sequence[str], channels: Sequence[str]) -> DataFrame:
    rows = [(o, c, float(m[i, j])) for i, o in enumerate(outs) for j, c in enumerate(channels)]
    return spark.createDataFrame(rows, "out string, channel string, w double")


def select(df: DataFrame, include: Mapping[str, Sequence] | None = None, exclude: Mapping[str, Sequence] | None = None, ranges: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """Rows by lists of values to keep or to leave out and by closed intervals."""
    for c, v in (include or {}).items():
        df = df.where(F.col(c).isin(list(v)))
    for c, v in (exclude or {}).items():
        df = df.where(~F.coalesce(F.col(c).isin(list(v)), F.lit(False)))
    for c, (lo, hi) in (ranges or {}).items():
        df = df.where(F.col(c).between(lo, hi))
    return df


def reindex(df: DataFrame, keys: Sequence[str], idx: str = "i") -> DataFrame:
    return df.withColumn(idx, F.row_number().over(W.partitionBy(*keys).orderBy(idx)).cast("long"))


def closest_channels(a: DataFrame, b: DataFrame, cell: float | None = None) -> DataFrame:
    """``(a, b, distance)``: for each position ``(label, x, y, z)`` of one table the nearest of the other, ties to the smaller label.

    Any number of positions; ``cell`` is the first width looked at, see :func:`.sourcespace.nearest_points`.
    Positions with a null or NaN coordinate have no neighbour and are none; without any in ``b`` there are no rows.
    """
    got = nearest_points(a.select(F.col("label").alias("point"), *"xyz"), b.select(F.col("label").alias("target"), *"xyz"), cell)
    return got.select(F.col("point").alias("a"), F.col("target").alias("b"), F.col("dist").alias("distance"))


def match_labels(a: DataFrame, b: DataFrame) -> DataFrame:
    """Channels of two tables with one name, case aside."""
    return a.select(F.col("label").alias("a"), F.lower("label").alias("k")).join(b.select(F.col("label").alias("b"), F.lower("label").alias("k")), "k").drop("k")


def merge_channels(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both tables, one row for each label, the first table's before the second's."""
    both = a.withColumn("o_", F.lit(0)).unionByName(b.withColumn("o_", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("r_", F.row_number().over(W.partitionBy("label").orderBy("o_"))).where("r_ = 1").drop("o_", "r_")


def rigid_transform(df: DataFrame, angles: tuple[float, float, float], scale: float = 1.0, shift: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Positions turned about z, y and x (Rz Ry Rx), scaled and moved."""
    ax, ay, az = angles
    rx = np.array([[1, 0, 0], [0, np.cos(ax), -np.sin(ax)], [0, np.sin(ax), np.cos(ax)]])
    ry = np.array([[np.cos(ay), 0, np.sin(ay)], [0, 1, 0], [-np.sin(ay), 0, np.cos(ay)]])
    rz = np.array([[np.cos(az), -np.sin(az), 0], [np.sin(az), np.cos(az), 0], [0, 0, 1]])
    m = scale * (rz @ ry @ rx)
    xyz = [F.col(c) for c in "xyz"]
    return df.withColumns({c: sum((float(m[i, j]) * xyz[j] for j in range(3)), F.lit(float(shift[i]))) for i, c in enumerate("xyz")})


def to_spherical(df: DataFrame) -> DataFrame:
    """Adds azimuth and elevation (degrees) and radius from x, y, z."""
    flat = F.hypot("x", "y")
    return df.withColumns({"sph_theta": F.degrees(F.atan2("y", "x")), "sph_phi": F.degrees(F.atan2(F.col("z"), flat)), "sph_radius": F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)})


def to_cartesian(df: DataFrame) -> DataFrame:
    t, p, r = F.radians("sph_theta"), F.radians("sph_phi"), F.col("sph_radius")
    return df.withColumns({"x": r * F.cos(p) * F.cos(t), "y": r * F.cos(p) * F.sin(t), "z": r * F.sin(p)})


def to_polar(df: DataFrame) -> DataFrame:
    """Adds the flat head map's angle (clockwise from the nose) and radius (0.5 at the equator)."""
    return df.withColumns({"theta": -F.col("sph_theta"), "radius": 0.5 - F.col("sph_phi") / 180})


def from_polar(df: DataFrame) -> DataFrame:
    return df.withColumns({"sph_theta": -F.col("theta"), "sph_phi": (0.5 - F.col("radius")) * 180})
