"""Source estimates over groups, and their summaries by region and hour."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..storage import checkpointed


def lead_matrix(lead: DataFrame) -> tuple[np.ndarray, list[int]]:
    """Matrix ``(sensor, voxel x axis)`` of a lead-field table and its voxels; a model of fixed size, not data."""
    p = lead.toPandas()
    m = p.pivot_table(index="sensor", columns=["voxel", "axis"], values="w", sort=True)
    return m.to_numpy(), sorted({int(v) for v, _ in m.columns})


def localize(samples: DataFrame, keys: list[str], lead: np.ndarray, voxels: Sequence[int], per_voxel: int = 1, steps: int = 80, noise_update: str | None = None, noise_scale: float = 1e-6, sensor: str = "sensor", idx: str = "i", value: str = "v") -> DataFrame:
    """``(keys, voxel, power, status)``: sparse Bayesian power of each voxel for each group of samples.

    Power is the mean over time of the mean square over axes. A group whose estimate
    fails has status ``failed`` and zero power.
    """
    vox = np.asarray(voxels)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        head = {k: pdf[k].iloc[0] for k in keys}
        try:
            y = pdf.pivot_table(index=sensor, columns=idx, values=value).sort_index().to_numpy(float)
            noise = np.linalg.norm(y @ y.T, 2) * noise_scale * np.eye(len(y))
            _v, w, _s, _l = K.champagne(y, lead, noise, steps, per_voxel, noise_update=noise_update)
            x2 = ((w @ y) ** 2).mean(axis=1).reshape(-1, per_voxel).mean(axis=1)
            status = "ok"
        except (np.linalg.LinAlgError, ValueError):
            x2, status = np.zeros(len(vox)), "failed"
        return pd.DataFrame({**head, "voxel": vox, "power": x2, "status": status})

    kinds = dict(samples.dtypes)
    return samples.groupBy(*keys).applyInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "voxel int", "power double", "status string"]))


def reconstruct(samples: DataFrame, keys: list[str], lead: np.ndarray, voxels: Sequence[int], srate: float, segment: int, band: tuple[float, float] = (8.0, 13.0), per_voxel: int = 3, steps: int = 25, sensor: str = "sensor", idx: str = "i", value: str = "v") -> DataFrame:
    """``(keys, voxel, freq, psd, band_db)``: noise learned with the sources, then beamformer courses and their spectra."""
    vox = np.asarray(voxels)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.pivot_table(index=sensor, columns=idx, values=value).sort_index().to_numpy(float)
        noise = np.linalg.norm(y @ y.T, 2) * 1e-6 * np.eye(len(y))
        v, _w, sigma, _l = K.champagne(y, lead, noise, steps, per_voxel, noise_update="mackay")
        course = K.beamformer(y, lead, lead * v @ lead.T + sigma, per_voxel)
        f, p = K.welch(course, srate, segment)
        db = 10 * np.log10(np.maximum(K.band_power(f, p, *band), 1e-300))
        n = len(f)
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "voxel": np.repeat(vox, n), "freq": np.tile(f, len(vox)), "psd": p.reshape(-1), "band_db": np.repeat(db, n)})

    kinds = dict(samples.dtypes)
    return samples.groupBy(*keys).applyInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "voxel int", "freq double", "psd double", "band_db double"]))


def region_mean(values: DataFrame, voxels: DataFrame, rois: DataFrame, keys: list[str], value: str = "power", skip: Sequence[str] = ("Other",), extra: Sequence[str] = ()) -> DataFrame:
    """``(keys, roi, value)``: mean over a region's inner voxels, NaN left out; the skipped regions go."""
    atlas = voxels.where("inside").join(F.broadcast(rois), "tissue_code").where(~F.col("roi").isin(list(skip))).select("voxel", "roi")
    j = values.join(F.broadcast(atlas), "voxel")
    return j.groupBy(*keys, *extra, "roi").agg(F.avg(F.when(~F.isnan(value), F.col(value))).alias(value))


def all_regions(means: DataFrame, rois: DataFrame, keys: list[str], value: str, skip: Sequence[str] = ("Other",)) -> DataFrame:
    """A row for each region, null where none of its voxels has a value."""
    grid = means.select(*keys).distinct().join(F.broadcast(rois.where(~F.col("roi").isin(list(skip))).select("roi")))
    return grid.join(means, [*keys, "roi"], "left").select(*keys, "roi", value)


def wide_regions(means: DataFrame, keys: list[str], value: str, names: Sequence[str]) -> DataFrame:
    """One column for each region; the names are given, so that no pass looks for them."""
    return means.groupBy(*keys).pivot("roi", list(names)).agg(F.first(value))


def colour_limits(means: DataFrame, keys: list[str], value: str, low: float = 0.1) -> DataFrame:
    """Each row with its feature's lower percentile and largest value over all hours."""
    lim = means.groupBy(*keys).agg(F.percentile(value, F.lit(low)).alias("c_lo"), F.max(value).alias("c_hi"))
    return means.join(lim, keys)


def top_voxels(power: DataFrame, n: int) -> DataFrame:
    total = power.groupBy("voxel").agg(F.sum("power").alias("power"))
    return total.orderBy(F.desc("power"), "voxel").limit(n)


#: Targets up to this many are sent to every task; more are looked up by cells.
FEW_TARGETS = 4096
#: Places that a task compares with the targets around them, on average at most.
PLACES_PER_TASK = 20_000


def _placed(df: DataFrame, name: str) -> DataFrame:
    ok = [F.col(a).isNotNull() & ~F.isnan(F.col(a).cast("double")) for a in "xyz"]
    return df.where(ok[0] & ok[1] & ok[2]).select(name, *[F.col(a).cast("double").alias(a) for a in "xyz"])


def _around(places: DataFrame, targets: DataFrame, cell: float, tasks: int) -> DataFrame:
    """``(x, y, z, m)``: of each place the nearest ``(dist, target)`` among the cells around its own, null if they are empty.

    A target goes to its cell and those around it; a place stands in its own alone.
    """
    # a little wider, so that division never parts what is a cell's width apart by two cells
    c = lambda v: F.floor(F.col(v) / (cell * (1 + 1e-9)))
    steps = F.array(*[F.struct(*[F.lit(d).alias(a) for a, d in zip("xyz", (i, j, k), strict=True)]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    v = targets.select("target", *[F.col(a).alias(f"v{a}") for a in "xyz"]).withColumn("d_", F.explode(steps))
    v = v.withColumns({f"c{a}": c(f"v{a}") + F.col(f"d_.{a}") for a in "xyz"}).drop("d_")
    # tasks by number: what a join of cells gives is far more than what it reads
    g = places.withColumns({f"c{a}": c(a) for a in "xyz"}).repartition(tasks, "cx", "cy", "cz")
    d = F.sqrt(sum(((F.col(a) - F.col(f"v{a}")) ** 2 for a in "xyz"), F.lit(0.0)))
    return g.join(v, ["cx", "cy", "cz"], "left").groupBy(*"xyz").agg(F.min(F.when(F.col("vx").isNotNull(), F.struct(d.alias("dist"), "target"))).alias("m"))


def _tasks(spark: SparkSession, places: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-places // PLACES_PER_TASK))


def _first_cell(targets: DataFrame, n: int) -> float:
    """Width of cells that hold about four of ``n`` evenly spread targets each."""
    edges = targets.agg(*[f(a).alias(f"{f.__name__}_{a}") for a in "xyz" for f in (F.min, F.max)]).first()
    wide = max(edges[f"max_{a}"] - edges[f"min_{a}"] for a in "xyz") or 1.0  # type: ignore[index]
    return wide / max(1.0, (n / 4) ** (1 / 3))


def nearest_points(points: DataFrame, targets: DataFrame, cell: float | None = None) -> DataFrame:
    """``points(point, x, y, z)`` and ``targets(target, x, y, z)`` to ``(point, target, dist)``: the nearest target of every point.

    A few targets are sent to all tasks. Of more, a point meets those in its cell and
    the cells around it; what is nearest there within a cell's width is nearest of all. Points
    without go on with cells of twice the width, until cells are as wide as all
    positions lie apart. Equal distances go to the smaller target. Points that repeat a
    name and a place give one row; without targets there are none.
    """
    p, t = _placed(points, "point").distinct(), _placed(targets, "target")
    n = t.count()
    if n <= FEW_TARGETS:
        v = t.select("target", *[F.col(a).alias(f"v{a}") for a in "xyz"])
        d = F.sqrt(sum(((F.col(a) - F.col(f"v{a}")) ** 2 for a in "xyz"), F.lit(0.0)))
        # a counted side against all points
        near = p.join(F.broadcast(v)).groupBy("point", *"xyz").agg(F.min(F.struct(d.alias("dist"), "target")).alias("m"))
        return near.select("point", "m.target", "m.dist")
    edges = t.select(*"xyz").unionAll(p.select(*"xyz")).agg(*[f(a).alias(f"{f.__name__}_{a}") for a in "xyz" for f in (F.min, F.max)]).first()
    wide = max(edges[f"max_{a}"] - edges[f"min_{a}"] for a in "xyz") or 1.0  # type: ignore[index]
    # about four targets in a cell of evenly spread ones
    cell = cell or wide / max(1.0, (n / 4) ** (1 / 3))
    widths = [cell]
    while widths[-1] < wide:
        widths.append(2 * widths[-1])
    near = _by_rounds(p, t, widths, None)
    return p.join(near, list("xyz")).select("point", "m.target", "m.dist")


def _by_rounds(points: DataFrame, targets: DataFrame, widths: list[float], limit: float | None) -> DataFrame:
    """``(x, y, z, m)``: the nearest target of each place, looked for in cells of the first width and, where none is within a cell's width, of the next ones.

    In the last round everything found counts or, with a ``limit``, what is no farther. Points of one place are looked up once.
    """
    spark = points.sparkSession
    left = checkpointed(points.select(*"xyz").distinct(), "places")
    done = None
    for width in widths:
        last = width == widths[-1]
        n = left.count()
        if not n and done is not None:
            break
        got = checkpointed(_around(left, targets, width, _tasks(spark, n)), "near")
        near = got.where(F.col("m.dist") <= (limit if last else width)) if not last or limit is not None else got.where("m is not null")
        done = near if done is None else done.unionByName(near)
        left = got.where(F.col("m").isNull() | (F.col("m.dist") > width)).drop("m")
    return done  # type: ignore[return-value]


def nearest_voxels(grid: DataFrame, voxels: DataFrame, cell: float) -> DataFrame:
    """``(point, voxel, dist)``: the nearest voxel of each grid point, if it is at most ``cell`` away.

    It is looked for in cells that hold a few voxels each, then in wider ones up to ``cell``, so that the work of a point does
    not grow with the number of voxels. Of voxels at one place the smallest stands for all. Points without one are
    left out; :func:`nearest_points` finds the nearest at any distance.
    """
    p = _placed(grid, "point").distinct()
    t = checkpointed(_placed(voxels, "voxel").groupBy(*"xyz").agg(F.min("voxel").alias("target")), "voxels")
    n = t.count()
    halvings = min(20, max(0, math.ceil(math.log2(cell / _first_cell(t, n))))) if n else 0
    near = _by_rounds(p, t, [cell / 2**k for k in range(halvings, -1, -1)], cell)
    return p.join(near, list("xyz")).select("point", F.col("m.target").alias("voxel"), F.col("m.dist").alias("dist"))


def hour_of(df: DataFrame, seconds: str, length: float = 3600.0, out: str = "hour") -> DataFrame:
    return df.withColumn(out, F.floor(F.col(seconds) / length).cast("int"))


def hour_flags(bursts: DataFrame, recordings: DataFrame, keys: list[str], hours: int, seconds: str = "t") -> DataFrame:
    """``(keys, hour, n, flag)`` of every hour up to ``hours``; those without a burst have flag 0."""
    grid = recordings.select(*keys).distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(hours - 1))))
    n = hour_of(bursts, seconds).groupBy(*keys, "hour").agg(F.count("*").alias("n"))
    return grid.join(n, [*keys, "hour"], "left").select(*keys, "hour", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce((F.col("n") > 0).cast("int"), F.lit(0)).alias("flag"))


def first_per_hour(bursts: DataFrame, keys: list[str], most: int, seconds: str = "t", tie: Sequence[str] = ()) -> DataFrame:
    h = hour_of(bursts, seconds)
    return h.withColumn("rank", F.row_number().over(W.partitionBy(*keys, "hour").orderBy(seconds, *tie))).where(F.col("rank") <= most)


def onset_seconds(bursts: DataFrame, srate: float, offset: str | None = None) -> DataFrame:
    """Adds ``t``: the start in seconds, later by the recording's offset if there is one."""
    t = F.col("start_idx") / srate
    return bursts.withColumn("t", t + F.coalesce(F.col(offset), F.lit(0.0)) if offset else t)


def index_at(t0: float, srate: float, t: str) -> F.Column:
    """Nearest sample (from 1) to a time, on a regular clock."""
    return (F.round((F.col(t) - t0) * srate) + 1).cast("long")
