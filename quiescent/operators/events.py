"""Event tables: selection, context, epochs, counts and upkeep."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import checkpointed


def select_events(events: DataFrame, include: Mapping[str, Sequence | tuple] | None = None, omit: Mapping[str, Sequence | tuple] | None = None, inverse: bool = False, rename: str | None = None, type_col: str = "type") -> DataFrame:
    """Events that meet all conditions: a list is membership, a pair ``("range", lo, hi)`` an interval.

    ``omit`` negates its conditions, ``inverse`` the whole. With ``rename`` all
    events stay and the type of the selected ones changes.
    """

    def cond(c: str, v: Sequence | tuple) -> Column:
        hit = F.col(c).between(v[1], v[2]) if len(v) == 3 and v[0] == "range" else F.col(c).isin(list(v))
        return F.coalesce(hit, F.lit(False))

    ok = F.lit(True)
    for c, v in (include or {}).items():
        ok = ok & cond(c, v)
    for c, v in (omit or {}).items():
        ok = ok & ~cond(c, v)
    ok = ~ok if inverse else ok
    if rename is not None:
        return events.withColumn(type_col, F.when(ok, F.lit(rename)).otherwise(F.col(type_col)))
    return events.where(ok)


def previous_delay(events: DataFrame, keys: list[str], targets: Sequence[str], previous: Sequence[str], time: str = "latency", type_col: str = "type", tie: Sequence[str] = ()) -> DataFrame:
    """Target events with ``delay`` since the last event of the given types before them."""
    order = W.partitionBy(*keys).orderBy(time, *tie).rowsBetween(W.unboundedPreceding, -1)
    before = F.last(F.when(F.col(type_col).isin(list(previous)), F.col(time)), ignorenulls=True).over(order)
    return events.withColumn("delay", F.col(time) - before).where(F.col(type_col).isin(list(targets)))


def context(events: DataFrame, keys: list[str], targets: Sequence[str], neighbours: Sequence[str], positions: Sequence[int], time: str = "latency", type_col: str = "type", id_col: str = "event_id") -> DataFrame:
    """For each target and position the neighbour event that stands so many neighbours before (negative) or after it.

    Neighbours are numbered once; a target knows how many stand before it, so each
    position is an equality.
    """
    near = F.col(type_col).isin(list(neighbours)).cast("int")
    order = W.partitionBy(*keys).orderBy(time, id_col)
    d = events.withColumn("before_", F.coalesce(F.sum(near).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("own_", near)
    t = d.where(F.col(type_col).isin(list(targets)))
    pos = F.explode(F.array(*[F.lit(p) for p in positions]))
    t = t.select(*keys, F.col(id_col).alias("target_id"), F.col(time).alias("target_time"), "before_", "own_", pos.alias("position"))
    rank = F.when(F.col("position") < 0, F.col("before_") + F.col("position") + 1).otherwise(F.col("before_") + F.col("own_") + F.col("position"))
    n = d.where("own_ = 1").select(*keys, (F.col("before_") + 1).alias("rank_"), F.col(id_col).alias("neighbour_id"), F.col(type_col).alias("neighbour_type"), F.col(time).alias("neighbour_time"))
    return t.withColumn("rank_", rank).join(n, [*keys, "rank_"], "left").drop("rank_", "before_", "own_")


def type_counts(events: DataFrame, type_col: str = "type") -> DataFrame:
    return events.groupBy(type_col).agg(F.count("*").alias("n"))


def epoch_counts(events: DataFrame, keys: list[str], epoch: str = "epoch", type_col: str = "type") -> DataFrame:
    """Events, and epochs that hold one, by type."""
    return events.groupBy(*keys, type_col).agg(F.count("*").alias("n_events"), F.count_distinct(epoch).alias("n_epochs"))


def field_histogram(events: DataFrame, field: str, bins: int, width: float = 3.0) -> DataFrame:
    """``(bin, lo, n)`` of a numeric field in equal bins over its mean and ``width`` deviations, outer values in the end bins."""
    s = events.agg(F.avg(field).alias("m"), F.stddev_samp(field).alias("sd"))
    d = events.select(F.col(field).cast("double").alias("x")).where("x is not null").join(F.broadcast(s))
    lo, step = F.col("m") - width * F.col("sd"), 2 * width * F.col("sd") / bins
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("x") - lo) / step)))
    return d.groupBy(b.cast("int").alias("bin")).agg(F.min(lo + b * step).alias("lo"), F.count("*").alias("n"))


def cut_epochs(samples: DataFrame, events: DataFrame, keys: list[str], lo: int, hi: int, idx: str = "i", at: str = "latency", limits: tuple[float, float] | None = None, value: str = "v", channel: Sequence[str] = ()) -> DataFrame:
    """Samples from ``lo`` to ``hi`` around each event: ``(keys, epoch, t, ...)``; incomplete epochs go.

    Each event lists the indices it wants, so the join is an equality. With
    ``limits`` an epoch that has a value outside them goes too.
    """
    e = events.select(*keys, F.col("event_id").alias("epoch"), F.floor(at).cast("long").alias("at_"))
    e = e.withColumn("t", F.explode(F.sequence(F.lit(lo), F.lit(hi)))).withColumn(idx, F.col("at_") + F.col("t"))
    part = W.partitionBy(*keys, *channel, "epoch")
    j = samples.join(e, [*keys, idx]).withColumn("n_", F.count("*").over(part)).where(F.col("n_") == hi - lo + 1)
    if limits is not None:
        j = j.withColumn("ok_", F.min(F.col(value).between(*limits)).over(W.partitionBy(*keys, "epoch"))).where("ok_").drop("ok_")
    return j.drop("n_", "at_")


def epoch_events(epochs: DataFrame, events: DataFrame, keys: list[str], lo: float, hi: float, bucket: float) -> DataFrame:
    """All events inside each epoch's window: ``(keys, epoch, event_id, rel)``."""
    e = epochs.select(*keys, "epoch", F.col("latency").alias("at"))
    first, last = F.floor((F.col("at") + lo) / bucket), F.floor((F.col("at") + hi) / bucket)
    e = e.withColumn("b_", F.explode(F.sequence(first, last)))
    v = events.withColumn("b_", F.floor(F.col("latency") / bucket))
    j = e.join(v, [*keys, "b_"]).withColumn("rel", F.col("latency") - F.col("at"))
    return j.where(F.col("rel").between(lo, hi)).select(*keys, "epoch", "event_id", "rel")


def regular_epochs(samples: DataFrame, every: int, length: int, idx: str = "i") -> DataFrame:
    """Samples with the ``epoch`` (from 1) and ``t`` of each grid window that holds them; windows may overlap."""
    last = F.floor((F.col(idx) - 1) / every)
    first = F.greatest(F.lit(0), F.floor((F.col(idx) - 1 - length) / every) + 1)
    d = samples.withColumn("e_", F.explode(F.sequence(first, last)))
    return d.withColumns({"epoch": F.col("e_") + 1, "t": F.col(idx) - F.col("e_") * every}).where(F.col("t") <= length).drop("e_")


def to_continuous(epochs: DataFrame, points: int) -> DataFrame:
    """Index of an epoch's sample in the epochs laid end to end."""
    return epochs.withColumn("i", (F.col("epoch") - 1) * points + F.col("t"))


def edge_events(samples: DataFrame, keys: list[str], channel: str, edge: str = "both", min_gap: int = 0, idx: str = "i", value: str = "v") -> DataFrame:
    """Events at the edges of a channel's absolute value: ``(keys, event_id, type, latency, duration, edge)``.

    An edge closer than ``min_gap`` to the one before goes. The type is the
    channel's name where the channel has two values, else the value it takes.
    ``duration`` runs from a leading to the next trailing edge.
    """
    order = W.partitionBy(*keys, channel).orderBy(idx)
    d = samples.withColumn("a_", F.abs(value)).withColumn("step_", F.signum(F.col("a_") - F.lag("a_").over(order)))
    kinds = samples.groupBy(*keys, channel).agg((F.count_distinct(value) <= 2).alias("two_"))
    e = d.where("step_ <> 0").withColumn("edge", F.when(F.col("step_") > 0, F.lit("leading")).otherwise(F.lit("trailing")))
    e = e.withColumn("next_", F.lead(F.when(F.col("edge") == "trailing", F.col(idx)), 1).over(order))
    if edge != "both":
        e = e.where(F.col("edge") == edge)
    if min_gap:
        gap = F.col(idx) - F.lag(idx).over(order)
        e = e.withColumn("gap_", gap).where(F.col("gap_").isNull() | (F.col("gap_") >= min_gap))
    e = e.join(kinds, [*keys, channel])
    kind = F.when(F.col("two_"), F.concat(F.lit("chan"), F.col(channel).cast("string"))).otherwise(F.col(value).cast("string"))
    dur = F.when(F.col("edge") == "leading", (F.col("next_") - F.col(idx)).cast("double"))
    return e.select(*keys, channel, kind.alias("type"), F.col(idx).cast("double").alias("latency"), dur.alias("duration"), "edge")


def add_events(events: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables; fields that one lacks are null in its rows."""
    return events.unionByName(new, allowMissingColumns=True)


def edit_field(events: DataFrame, field: str, value: Column | None = None, where: Column | None = None, rename: str | None = None) -> DataFrame:
    """Sets, renames or (with neither) deletes a field."""
    if rename:
        return events.withColumnRenamed(field, rename)
    if value is None:
        return events.drop(field)
    if where is None:
        return events.withColumn(field, value)
    old = F.col(field) if field in events.columns else F.lit(None)
    return events.withColumn(field, F.when(where, value).otherwise(old))


def nest_by_epoch(events: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each epoch with its events in time order."""
    fields = [c for c in events.columns if c not in (*keys, "epoch")]
    rest = [c for c in fields if c != "latency"]
    return events.groupBy(*keys, "epoch").agg(F.array_sort(F.collect_list(F.struct("latency", *rest))).alias("events"))


def unnest(epochs: DataFrame, keys: list[str]) -> DataFrame:
    return epochs.select(*keys, "epoch", F.explode("events").alias("e")).select(*keys, "epoch", "e.*")


def point_to_ms(point: Column, srate: float, epoch_start: Column | float = 0.0) -> Column:
    """Latency in samples (from 1) to milliseconds from the epoch's time zero."""
    return (point - 1) / srate * 1000 + epoch_start


def ms_to_point(ms: Column, srate: float, epoch_start: Column | float = 0.0) -> Column:
    return (ms - epoch_start) / 1000 * srate + 1


def original_latency(events: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the latency before cuts: what the boundary events up to here have taken is added again."""
    order = W.partitionBy(*keys).orderBy("latency").rangeBetween(W.unboundedPreceding, 0)
    gone = F.sum(F.when(F.col("type") == "boundary", F.col("duration")).otherwise(F.lit(0.0))).over(order)
    return events.withColumn("ur_latency", F.col("latency") + F.coalesce(gone, F.lit(0.0)))


def merge_datasets(first: DataFrame, second: DataFrame, n_first: int, first_ev: DataFrame, second_ev: DataFrame, dataset_id: str) -> tuple[DataFrame, DataFrame]:
    """Samples and events of two datasets laid end to end, with a boundary event between them."""
    s = first.unionByName(second.withColumn("i", F.col("i") + n_first)).withColumn("dataset_id", F.lit(dataset_id))
    mark = first_ev.sparkSession.createDataFrame([("boundary", n_first + 0.5, 0.0)], "type string, latency double, duration double")
    e = first_ev.unionByName(second_ev.withColumn("latency", F.col("latency") + n_first), allowMissingColumns=True).unionByName(mark, allowMissingColumns=True)
    return s, e.withColumn("dataset_id", F.lit(dataset_id))


def event_lags(epochs: DataFrame, lags: DataFrame, keys: list[str], most: int, trial: str = "trial", t: str = "t", value: str = "v") -> DataFrame:
    """``(keys, trial, lag)``: one round of alignment. With the ``lags`` so far the trials of a key are averaged; each trial then
    takes the lag, of those up to ``most`` either way, at which its samples have the largest sum of products with the average.

    A lag moves a trial to earlier times. Of equal sums the smaller lag in size goes
    first, then the negative one. Null values and times that a trial does not have add nothing.
    """
    e = epochs.where(F.col(value).isNotNull()).select(*keys, trial, F.col(t).alias("t_"), F.col(value).cast("double").alias("v_"))
    moved = e.join(lags.select(*keys, trial, "lag"), [*keys, trial]).withColumn("t_", F.col("t_") - F.col("lag"))
    template = moved.groupBy(*keys, "t_").agg(F.avg("v_").alias("m_"))
    tried = e.withColumn("lag", F.explode(F.sequence(F.lit(-most), F.lit(most)))).withColumn("t_", F.col("t_") - F.col("lag"))
    # a template has a value for each time of an epoch
    score = tried.join(template, [*keys, "t_"], "left").groupBy(*keys, trial, "lag").agg(F.coalesce(F.round(F.sum(F.col("v_") * F.col("m_")), 9), F.lit(0.0)).alias("s_"))
    best = score.groupBy(*keys, trial).agg(F.max_by("lag", F.struct("s_", -F.abs("lag"), -F.col("lag"))).alias("lag"))
    return best.select(*keys, trial, F.col("lag").cast("int").alias("lag"))


def align_events(epochs: DataFrame, keys: list[str], most: int, rounds: int = 20, trial: str = "trial", t: str = "t", value: str = "v") -> tuple[DataFrame, int]:
    """The lags of :func:`event_lags` after so many rounds that none changes, or ``rounds``; and how many there were."""
    lags = checkpointed(epochs.select(*keys, trial).distinct().withColumn("lag", F.lit(0)), "lags")
    for k in range(1, rounds + 1):
        new = checkpointed(event_lags(epochs, lags, keys, most, trial, t, value), "lags")
        if new.join(lags.withColumnRenamed("lag", "old_"), [*keys, trial]).where("lag <> old_").isEmpty():
            return new, k
        lags = new
    return lags, rounds
