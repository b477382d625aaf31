"""Registered queries over the driver tables.

``events`` stands for recordings: a user is a recording, an event type a channel, the
rank in time an index, and the value a sample.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import distance, names, tablefunctions
from ..operators import averages, decompose, detect, events, knn, linkage, montage, neighbours, ranges, recursive, reject, signal, similarity, sourcespace, stats, timeline
from ..sources import bucketed
from ..storage import exists, new_folder
from ..streaming import ordered, stateful

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

BETA, THRESHOLD, WINDOW = 0.8, 1200.0, 10
#: Micro-batches of the streamed samples.
LATE_BATCHES = 3


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(user_id, event_id, channel, ts, i, v)``."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("channel"), "ts", F.col("value").alias("v"))
    return detect.with_index(e, ["user_id"], ["ts", "event_id"])


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(user_id, event_id, type, latency, value)`` with latencies in whole microseconds as seconds."""
    e = table(spark, sf_dir, "events")
    sec = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return e.select("user_id", "event_id", F.col("event_type").alias("type"), sec.alias("latency"), "value")


def r6(c: Column | str, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double"), 6).alias(name or c)  # type: ignore[arg-type]


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.local_labels(samples(spark, sf_dir), ["user_id"], BETA, THRESHOLD)


# ------------------------------------------------------------------ detection


@query
def bsr_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = recursive.suppression_ratio(labelled(spark, sf_dir), ["user_id"], WINDOW)
    return detect.episodes(ratio, ["user_id"], 0.5, 1.0, 2, 3).select("user_id", "start_idx", "end_idx", "n")


@query
def ema_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("user_id", "i", r6("mu"), r6(F.col("var"), "variance"))


@query
def ema_variance_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s"))
    s = s.select("user_id", F.posexplode(recursive.ema_variance_array(F.col("s.v"), BETA)).alias("p", "x"))
    return s.select("user_id", (F.col("p") + 1).cast("long").alias("i"), r6("x", "variance"))


@query
def suppression_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).withColumns({"z": (F.col("v") > 40).cast("int"), "art": (F.col("v") > 250).cast("int")})
    return recursive.suppression_ratio(s, ["user_id"], WINDOW, artifact="art").select("user_id", "i", r6("bsr"))


@query
def index_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.index_ranges(samples(spark, sf_dir).where("v > 40"), ["user_id"], tol=2)


@query
def ranges_by_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``index_ranges`` from SQL, by a table function that holds one range at a time."""
    tablefunctions.register(spark)
    samples(spark, sf_dir).where("v > 40").select("user_id", "i").createOrReplaceTempView("high_samples")
    return spark.sql("SELECT user_id, start_idx, end_idx, n FROM index_ranges(TABLE(high_samples), 'user_id', 'i', 2)")


@query
def bucketed_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with the range that holds them, from two tables bucketed alike: the join moves no row."""
    s = samples(spark, sf_dir).select("user_id", "i", "v")
    r = ranges.index_ranges(s.where("v > 40"), ["user_id"], tol=2).select("user_id", "start_idx", "end_idx")
    folder = new_folder(spark, "bucketed")
    mark = folder[-32:]
    bucketed.save_bucketed(bucketed.with_block(s), f"samples_{mark}", f"{folder}/samples", ["user_id"], 16, ["i"])
    bucketed.save_bucketed(bucketed.blocks_of_ranges(r), f"ranges_{mark}", f"{folder}/ranges", ["user_id"], 16)
    return bucketed.in_ranges(spark, f"samples_{mark}", f"ranges_{mark}", ["user_id"]).select("user_id", "i", "start_idx", r6("v"))


@query
def short_quiet_relabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).withColumn("z", (F.col("v") > 40).cast("int"))
    return recursive.relabel_short_quiet(s, ["user_id"], 3).select("user_id", "i", "z")


@query
def channel_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).withColumn("hour", F.date_trunc("hour", "ts"))
    by = s.groupBy("hour", "channel").agg((F.max("v") > 100).cast("int").alias("z"))
    return detect.channel_vote(by, ["hour"], 5).select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "valid", "z")


@query
def artifact_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.artifact_chunks(samples(spark, sf_dir), ["user_id"], 10, 200.0, 1e-4)


@query
def artifact_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    ch = samples(spark, sf_dir).groupBy("user_id", (F.floor((F.col("i") - 1) / 5) + 1).alias("epoch"))
    ep = ch.agg((F.max("v") > 200).alias("saturated"), (F.min("v") < 1).alias("flat"))
    return reject.dirty_fraction(ep, ["user_id"], ["saturated", "flat"], 4).select("user_id", "block", r6("dirty"))


@query
def burst_in_episode(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = recursive.suppression_ratio(labelled(spark, sf_dir), ["user_id"], WINDOW)
    eps = detect.episodes(ratio, ["user_id"], 0.5, 1.0, 2, 3)
    return detect.bursts(ratio, eps, ["user_id"], 2)


@query
def point_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    r = ranges.index_ranges(s.where("channel = 'click'"), ["user_id"], tol=3).select("user_id", "start_idx", "end_idx")
    return ranges.points_in_ranges(s.select("user_id", "i", "event_id"), r, ["user_id"], bucket=16).select("user_id", "event_id", "i", "start_idx", "end_idx")


@query
def merge_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.merge_regions(spans(spark, sf_dir), ["o_custkey"], "a", "b", 1)


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ranges of days from order to last shipment."""
    day = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date"))
    ship = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("s"))
    j = table(spark, sf_dir, "orders").join(ship, F.col("o_orderkey") == F.col("l_orderkey"))
    return j.select("o_custkey", "o_orderkey", day("o_orderdate").alias("a"), F.greatest(day("o_orderdate"), day("s")).alias("b"))


@query
def redundant_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.contained_ranges(spans(spark, sf_dir), ["o_custkey"], "o_orderkey", "a", "b")


@query
def redundant_ranges_mutual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.contained_ranges(spans(spark, sf_dir), ["o_custkey"], "o_orderkey", "a", "b", mutual=True)


@query
def excised_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    bad = ranges.index_ranges(s.where("v > 120"), ["user_id"], tol=2)
    out = ranges.excise(s.select("user_id", "event_id", "i"), bad, ["user_id"])
    return out.select("user_id", "event_id", "old_i", "i")


@query
def shifted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    bad = ranges.index_ranges(s.where("v > 120"), ["user_id"], tol=2)
    ev = s.select("user_id", F.col("channel").alias("type"), F.col("i").cast("double").alias("latency"), F.lit(0.0).alias("duration"))
    return ranges.shift_events(ev, bad, ["user_id"]).select("user_id", "type", "latency", "duration")


@query
def kept_around_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    ev = s.where("v > 150").select("user_id", F.col("i").cast("double").alias("latency"))
    return ranges.keep_around_events(s.select("user_id", "i", "event_id"), ev, ["user_id"], -2, 3)


@query
def removed_around_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    ev = s.where("v > 150").select("user_id", F.col("i").cast("double").alias("latency"))
    return ranges.keep_around_events(s.select("user_id", "i", "event_id"), ev, ["user_id"], -2, 3, invert=True)


# ------------------------------------------------------------------ time grids


def hours(df: DataFrame) -> Column:
    return F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3600e6)).cast("long")


@query
def hour_grid_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    t0 = s.groupBy("user_id").agg(F.min("ts").alias("t0"))
    sec = s.where("v > 100").join(t0, "user_id").withColumn("t", F.timestamp_diff("MICROSECOND", "t0", "ts") / 1e6)
    return sourcespace.hour_flags(sec, s, ["user_id"], 24)


@query
def top_n_per_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return sourcespace.first_per_hour(s.withColumn("all", F.lit(0)), ["all"], 5, "t", ["event_id"]).select("hour", "event_id", "rank")


@query
def timeline_72h(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sid"), F.col("o_orderkey").alias("name"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").cast("long").alias("nsamples"))
    return timeline.place_recordings(o, 0.01, hours=24.0 * 365)


@query
def merged_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).withColumn("seg", F.floor((F.col("i") - 1) / 20).cast("int"))
    d = s.select("user_id", "seg", ((F.col("i") - 1) % 20 + 1).alias("i"), "v")
    seg = d.select("seg").distinct().withColumn("start", F.col("seg").cast("long") * 15)
    return timeline.merge_segments(d, seg, None, ["user_id"]).select("user_id", "i", "v")


@query
def segment_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return timeline.order_segments(o, "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", F.col("by_time").cast("long").alias("by_time"), F.col("by_name").cast("long").alias("by_name"))


@query
def remaining_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.remaining(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), ["doc_id"])


@query
def outcome_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return timeline.outcome_of(d, lab, "doc_id", "quality").select("doc_id", "quality")


@query
def offset_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    b = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("v"))
    return timeline.with_fallback(c, a, b, "k", "v")


@query
def recording_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).withColumnRenamed("user_id", "rec_id")
    return timeline.durations(s, 200.0).select("rec_id", "n_samples", F.col("n_channels").cast("long").alias("n_channels"), "seconds")


@query
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recursive.moving_average(samples(spark, sf_dir), ["user_id"], "i", "v", 3).select("user_id", "i", r6("avg"))


@query
def last_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).withColumn("x", F.when(F.col("v") < 80, F.col("v")))
    return recursive.last_known(s, ["user_id"], "i", "x", "filled").select("user_id", "i", "filled")


@query
def regular_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events.regular_epochs(samples(spark, sf_dir), 10, 20)
    return e.groupBy("user_id", "epoch").agg(F.count("*").alias("n"), r6(F.avg("v"), "mean"))


# ------------------------------------------------------------------ events


@query
def prev_event_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = events.previous_delay(markers(spark, sf_dir), ["user_id"], ["purchase"], ["click", "view"], tie=["event_id"])
    return d.select("user_id", "event_id", r6("delay"))


@query
def event_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = events.context(markers(spark, sf_dir), ["user_id"], ["purchase"], ["click"], [-2, -1, 1])
    return d.select("user_id", "target_id", "position", "neighbour_id")


@query
def select_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = events.select_events(markers(spark, sf_dir), {"type": ["click", "purchase"], "value": ("range", 10, 60)}, {"user_id": [1, 2, 3]})
    return d.select("event_id", "type", "value")


@query
def rename_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.select_events(markers(spark, sf_dir), {"value": ("range", 100, 1e9)}, rename="large").groupBy("type").agg(F.count("*").alias("n"))


@query
def event_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.type_counts(markers(spark, sf_dir))


@query
def event_epoch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = markers(spark, sf_dir).withColumn("epoch", F.floor(F.col("latency") / 86400))
    return events.epoch_counts(e, ["user_id"])


@query
def event_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.field_histogram(markers(spark, sf_dir), "value", 20, 2.0).select("bin", r6("lo"), "n")


@query
def edge_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).withColumn("gate", (F.col("v") > 60).cast("double"))
    e = events.edge_events(s.withColumn("all", F.lit(1)), ["user_id"], "all", min_gap=2, value="gate")
    return e.select("user_id", "type", "latency", "duration", "edge")


@query
def event_locked_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    ev = s.where("v > 150").select("user_id", "event_id", F.col("i").alias("latency"))
    ep = events.cut_epochs(s.select("user_id", "i", "v"), ev, ["user_id"], -3, 4)
    ep = montage.remove_baseline(ep, ["user_id", "epoch"], -3, -1)
    return ep.groupBy("t").agg(F.count("*").alias("n"), r6(F.avg("v"), "erp"), r6(F.stddev_samp("v"), "sd"))


@query
def epoch_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = markers(spark, sf_dir)
    ep = m.where("type = 'purchase'").select("user_id", F.col("event_id").alias("epoch"), "latency")
    return events.epoch_events(ep, m, ["user_id"], -3600.0, 7200.0, 3600.0).select("user_id", "epoch", "event_id", r6("rel"))


@query
def original_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    ev = s.select("user_id", "event_id", F.when(F.col("v") > 120, "boundary").otherwise(F.col("channel")).alias("type"), F.col("i").cast("double").alias("latency"), F.floor("v").cast("double").alias("duration"))
    return events.original_latency(ev, ["user_id"]).select("event_id", "ur_latency")


# ------------------------------------------------------------------ rejection


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with trials of 8 per user: ``(user_id, trial, t, v)``."""
    s = samples(spark, sf_dir)
    return s.withColumns({"trial": F.floor((F.col("i") - 1) / 8), "t": (F.col("i") - 1) % 8 + 1})


@query
def epoch_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = reject.epoch_moments(trials(spark, sf_dir), ["user_id", "trial"])
    return m.select("user_id", "trial", "n", *[(F.round(c, 9) + 0.0).alias(c) for c in ("variance", "skew", "kurt")])


@query
def population_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = trials(spark, sf_dir).groupBy("user_id", "trial").agg(F.var_samp("v").alias("variance"))
    return reject.population_outliers(m.where("variance is not null"), "variance", 2.0, True, 1e-3).select("user_id", "trial", "outlier")


@query
def band_power_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = trials(spark, sf_dir).groupBy("user_id", "trial").agg(F.sum(F.col("v") * F.col("v")).alias("power"))
    return reject.band_power_outliers(m, "power", 0.1, 3.0).select("user_id", "trial", "outlier")


@query
def threshold_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reject.threshold_reject(trials(spark, sf_dir), ["user_id"], "trial", 0.5, 150.0)


@query
def joint_prob_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = reject.joint_probability_reject(trials(spark, sf_dir), ["user_id"], "trial", 1.5, 50)
    return d.select("user_id", "trial", r6("jp"), r6("z"), "reject")


@query
def entropy_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = reject.entropy_reject(trials(spark, sf_dir), ["user_id"], "trial", 1.5, 50)
    return d.select("user_id", "trial", r6("entropy"), r6("z"), "reject")


@query
def kurtosis_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = reject.kurtosis_reject(trials(spark, sf_dir), ["user_id"], "trial", 1.5)
    return d.select("user_id", "trial", r6("kurt"), r6("z"), "reject")


@query
def trend_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = reject.trend_reject(trials(spark, sf_dir), ["user_id"], "trial", 5, 1, 80.0, 0.5)
    return d.select("user_id", "trial", r6("max_slope"), "reject")


@query
def robust_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    return s.withColumn("z", reject.robust_score(s, ["user_id"], "v")).select("event_id", r6("z"))


@query
def median_abs_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reject.mad(samples(spark, sf_dir), ["user_id"], "v").select("user_id", r6("med"), r6("mad"))


@query
def quality_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = samples(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.max("v").alias("hi"), F.avg("v").alias("m"))
    d = reject.quality_issues(g, ["user_id"], {"few": F.col("n") < 65, "peak": F.col("hi") > 300, "high": F.col("m") > 55})
    return d.select("user_id", F.array_join("issues", ",").alias("issues"))


# ------------------------------------------------------------------ references and channels


@query
def average_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).groupBy("user_id", "channel").agg(F.avg("v").alias("v"))
    return montage.average_reference(s, ["user_id"], exclude=["error"]).select("user_id", "channel", F.round("v", 9).alias("v"))


@query
def common_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).groupBy("user_id", "channel").agg(F.avg("v").alias("v"))
    return montage.common_reference(s, ["user_id"], ["click", "view"]).select("user_id", "channel", r6("v"))


@query
def baseline_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return montage.remove_baseline(trials(spark, sf_dir), ["user_id", "trial"], 1, 3).select("event_id", r6("v"))


@query
def bipolar_montage(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).groupBy("user_id", "channel").agg(F.avg("v").alias("v"))
    return montage.bipolar(s, ["user_id"], [("click", "view"), ("view", "purchase")]).select("user_id", "channel", r6("v"))


@query
def channel_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return montage.envelope(trials(spark, sf_dir), ["user_id", "t"])


@query
def standardized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.standardize(samples(spark, sf_dir), ["user_id"], "v").select("event_id", r6("z"))


# ------------------------------------------------------------------ statistics


@query
def hazen_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = stats.hazen_quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", [0.05, 0.25, 0.5, 0.9])
    return q.select("l_returnflag", "l_linestatus", "p", r6("q"))


@query
def median_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.median_interval(samples(spark, sf_dir), ["channel"], "v").select("channel", r6("median"), r6("lo"), r6("hi"), "n")


@query
def signal_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = stats.signal_stats(samples(spark, sf_dir), ["channel"], "v")
    return d.select("channel", "n", *[r6(c) for c in ("mean", "sd", "skew", "kurt", "lo", "q25", "median", "q75", "hi", "trimmed_mean")])


@query
def rms_and_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).groupBy("user_id").agg(r6(stats.rms("v"), "rms"), r6(stats.peak("v"), "peak"))


@query
def amplitude_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.amplitude_area(samples(spark, sf_dir), ["user_id"], "i", "v", 5, 20).select("user_id", r6("area"))


@query
def covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = stats.covariance(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return d.select("l_returnflag", F.round("cov", 3).alias("cov"), F.round("var_x", 6).alias("var_x"), F.round("var_y", 1).alias("var_y"), r6("r"))


@query
def regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = stats.regression(samples(spark, sf_dir), ["user_id"], "i", "v")
    return d.select("user_id", r6("slope"), r6("intercept"), r6("r2"), "n")


def halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two values of each user in each channel: means of its earlier and later half."""
    s = samples(spark, sf_dir)
    n = F.count("*").over(W.partitionBy("user_id"))
    s = s.withColumn("late", (F.col("i") * 2 > n).cast("int"))
    return s.groupBy("channel", "user_id").agg(F.avg(F.when(F.col("late") == 0, F.col("v"))).alias("a"), F.avg(F.when(F.col("late") == 1, F.col("v"))).alias("b"))


@query
def paired_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.paired_t(halves(spark, sf_dir), ["channel"], "a", "b").select("channel", r6("t"), "df")


@query
def unpaired_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.unpaired_t(samples(spark, sf_dir), ["user_id"], "channel", "click", "view", "v").select("user_id", r6("t"), r6("df"))


@query
def welch_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.unpaired_t(samples(spark, sf_dir), ["user_id"], "channel", "click", "view", "v", False).select("user_id", r6("t"), r6("df"))


@query
def anova1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.anova1(samples(spark, sf_dir), ["user_id"], "channel", "v").select("user_id", r6("f"), "df1", "df2")


@query
def anova1_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = samples(spark, sf_dir).groupBy("user_id", "channel").agg(F.avg("v").alias("v"))
    full = c.withColumn("k", F.count("*").over(W.partitionBy("user_id"))).where("k = 5")
    return stats.anova1_repeated(full, "user_id", "channel", "v").select(r6("f"), "df1", "df2")


@query
def anova2(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem")
    d = stats.anova2(p, "l_returnflag", "l_linestatus", "l_quantity")
    return d.select("effect", F.round("ss", 3).alias("ss"), "df", F.round("f", 4).alias("f"))


@query
def rank_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).withColumn("v", F.round("v"))
    return stats.rank_sum(s, ["user_id"], "channel", "click", "view", "v").select("user_id", r6("w"), r6("z"))


def p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A p for each user: the rank of its mean among all."""
    g = samples(spark, sf_dir).groupBy("user_id").agg(F.avg("v").alias("m"))
    r = F.rank().over(W.orderBy(F.desc("m")))
    return g.select("user_id", F.pow(r / F.count("*").over(W.partitionBy(F.lit(0))), 3).alias("p"))


@query
def fdr_bh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.fdr(p_values(spark, sf_dir), [], "p", 0.05).select("user_id", r6("p"), "significant")


@query
def fdr_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.fdr(p_values(spark, sf_dir), [], "p", 0.2, dependent=True).select("user_id", r6("p"), "significant")


def surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of channel means for each replicate of permuted labels, and the observed one."""
    s = samples(spark, sf_dir).where("channel in ('click', 'view')").select("event_id", "channel", "v")
    diff = F.avg(F.when(F.col("channel") == "click", F.col("v"))) - F.avg(F.when(F.col("channel") == "view", F.col("v")))
    perm = stats.permuted_labels(s, "event_id", "channel", 20).groupBy("replicate").agg(diff.alias("surrogate"))
    return perm.join(F.broadcast(s.agg(diff.alias("observed"))))


@query
def permutation_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates(spark, sf_dir).select("replicate", r6("surrogate"), r6("observed"))


@query
def surrogate_pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.surrogate_p(surrogates(spark, sf_dir), [], "observed", "surrogate").select(r6("p"))


@query
def surrogate_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.surrogate_interval(surrogates(spark, sf_dir), [], "surrogate", 0.2).select(r6("lo"), r6("hi"))


@query
def deterministic_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = stats.deterministic_split(table(spark, sf_dir, "customer"), "c_custkey", {"train": 0.7, "dev": 0.15, "test": 0.15})
    return d.select("c_custkey", "part")


@query
def sampled_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return stats.sample_queries(lab, "doc_id", 50, "toxic", 20)


# ------------------------------------------------------------------ averages


@query
def evoked_by_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return averages.evoked(trials(spark, sf_dir), ["channel", "t"]).select("channel", "t", r6("mean"), r6("sd"), "n")


@query
def grand_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return averages.grand_average(trials(spark, sf_dir), "user_id", ["t"]).select("t", r6("mean"), r6("sd"), "n")


@query
def condition_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = averages.compare_conditions(trials(spark, sf_dir), "user_id", "channel", "click", "view", ["t"])
    return d.select("t", *[F.round(c, 9).alias(c) for c in ("mean_a", "mean_b", "difference", "sd", "t_stat")], "n")


@query
def block_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    w = s.select((F.floor((F.col("i") - 1) / 8) + 1).alias("epoch")).distinct().withColumn("w", F.col("epoch") * 0.5)
    return averages.block_average(s, ["user_id"], 8, w).select("user_id", "t", r6("v"))


@query
def event_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trials(spark, sf_dir)
    peak = t.groupBy("user_id", "trial").agg(F.max("v").alias("peak"))
    return averages.event_correlation(t.join(peak, ["user_id", "trial"]), ["channel", "t"], "peak").select("channel", "t", r6("r"), "n")


@query
def components_by_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = averages.order_by_variance(samples(spark, sf_dir), ["user_id"], "channel").where("variance is not null")
    return d.select("user_id", "channel", r6("variance"), "rank")


@query
def slowest_worker(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = averages.slowest_then_median(samples(spark, sf_dir), "user_id", "channel", "v")
    return d.select(r6("median"), "workers", "n")


@query
def late_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ema_variance`` over a stream in which samples overtake each other by up to an hour."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("v"))
    e = e.where("user_id is not null and ts is not null and v is not null")
    arrives = F.unix_micros("ts") + F.pmod(F.xxhash64("event_id"), F.lit(3_600_000_000))
    lo, hi = e.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts")) + 3_600_000_000).first()  # type: ignore[misc]
    batch = F.floor((arrives - F.lit(lo)) * LATE_BATCHES / F.lit((hi or 0) - (lo or 0) + 1))
    queue, out, progress = (new_folder(spark, x) for x in ("late", "ordered", "progress"))
    ordered.needs_state_store(spark)
    for k in range(LATE_BATCHES + 1):
        part = e.where(batch == k) if k < LATE_BATCHES else ordered.end_marker(e, ["user_id"], "ts")
        part.write.mode("append").parquet(queue)
        # what has come is one micro-batch; each run goes on from the state that the one before has stored
        rows = ordered.ordered_ema_stream(spark.readStream.schema(e.schema).parquet(queue), ["user_id"], "ts", "event_id", "v", BETA, THRESHOLD, "1 hour")
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out).select("user_id", "i", r6("mu"), r6("var", "variance"))


# ------------------------------------------------------------------ neighbours

DIM = 64
AXIS = knn.AxisHash((-0.3,) * DIM, (0.3,) * DIM)
SIGN = knn.SignHash(DIM)
#: Bits and tables by recall on the tables of tests, with the probes of queries.
COSINE = (6, 10, 1)
LAYERS = knn.TwoLayers(AXIS, SIGN, 6, 12, 4, 6, 0.02, probes=1)


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    p = e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), (F.col("label") < 5).cast("int").alias("label"))
    return p, p.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))


@query
def knn_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, q = vectors(spark, sf_dir)
    return knn.exact_knn(p, q, 5, "l1").select("qid", "rank", "id", r6("dist"))


@query
def knn_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, q = vectors(spark, sf_dir)
    return knn.exact_knn(p, q, 5, "euclidean").select("qid", "rank", "id", r6("dist"))


@query
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, q = vectors(spark, sf_dir)
    return knn.exact_knn(p, q, 5, "cosine").select("qid", "rank", "id", r6("dist"))


@query
def lsh_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, q = vectors(spark, sf_dir)
    return knn.lsh_knn(p, q, AXIS, 6, 8, 5).select("qid", "rank", "id", r6("dist"))


@query
def lsh_cosine_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, q = vectors(spark, sf_dir)
    return knn.lsh_knn(p, q, SIGN, *COSINE[:2], 5, "cosine", probes=COSINE[2]).select("qid", "rank", "id", r6("dist"))


@query
def slsh_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, q = vectors(spark, sf_dir)
    return knn.slsh_knn(p, q, LAYERS, 5).select("qid", "rank", "id", r6("dist"))


def three_parts(p: DataFrame) -> list[DataFrame]:
    """The table in three parts by a hash of the id."""
    part = F.pmod(F.xxhash64("id"), F.lit(3))
    return [p.where(part == k) for k in range(3)]


def stored_index(spark: SparkSession, sf_dir: str) -> neighbours.NeighbourIndex:
    """An index of all embeddings: built of a third, the others appended one after the other."""
    p, _ = vectors(spark, sf_dir)
    first, *rest = three_parts(p.select("id", "vec"))
    index = neighbours.NeighbourIndex.create(spark, new_folder(spark, "index"), LAYERS, parts=16)
    for part in (first, *rest):
        index.append(part)
    return index


@query
def indexed_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours from a stored index that grew by appends."""
    _, q = vectors(spark, sf_dir)
    return stored_index(spark, sf_dir).nearest(q, 5).select("qid", "rank", "id", r6("dist"))


@query
def streamed_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries as a stream, each micro-batch answered from the stored index as it is then."""
    index = stored_index(spark, sf_dir)
    queue, out = new_folder(spark, "queue"), new_folder(spark, "answers")
    vectors(spark, sf_dir)[1].repartition(4, "qid").write.parquet(queue)
    stream = spark.readStream.schema("qid long, qvec array<double>").option("maxFilesPerTrigger", 2).parquet(queue)
    run = stateful.serve_queries(stream, lambda b: index.nearest(b, 5), lambda df, k: df.write.mode("overwrite").parquet(f"{out}/batch={k}"))
    run.option("checkpointLocation", new_folder(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema("qid long, rank int, id long, dist double").parquet(f"{out}/*") if exists(spark, out) else index.nearest(vectors(spark, sf_dir)[1], 5)
    return got.select("qid", "rank", "id", r6("dist"))


@query
def heavy_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _ = vectors(spark, sf_dir)
    return knn.heavy_buckets(knn.buckets(p, AXIS, 6, 8, 7), p.count(), 0.02).select(F.col("tbl").cast("long").alias("tbl"), "key", "n")


@query
def candidate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, q = vectors(spark, sf_dir)
    return knn.lsh_comparisons(p, q, AXIS, 6, 8, 7)


@query
def knn_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, q = vectors(spark, sf_dir)
    return knn.vote(knn.exact_knn(p, q, 5, "l1"), p.select("id", "label"))


@query
def accuracy_recall_mcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, q = vectors(spark, sf_dir)
    v = knn.vote(knn.exact_knn(p, q, 5, "l1"), p.select("id", "label")).join(p.select(F.col("id").alias("qid"), "label"), "qid")
    return knn.metrics(v).select("tp", "tn", "fp", "fn", r6("accuracy"), r6("recall"), r6("mcc"))


@query
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _ = vectors(spark, sf_dir)
    return p.select("id", r6(distance.norm2(F.col("vec")), "norm2"), r6(distance.unit(F.col("vec"))[0], "first"))


@query
def aligned_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lag at which each trial fits the average of its user's trials best, after one round."""
    t = trials(spark, sf_dir)
    return events.event_lags(t, t.select("user_id", "trial").distinct().withColumn("lag", F.lit(0)), ["user_id"], 2)


@query
def bootstrap_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the mean price by return flag, from 40 replicates that share one pass over the rows."""
    b = stats.poisson_bootstrap(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", ["l_orderkey", "l_linenumber"], 40)
    return stats.surrogate_interval(b, ["l_returnflag"], "mean", 0.1).select("l_returnflag", r6("lo"), r6("hi"))


# ------------------------------------------------------------------ decompositions


def embedding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))


@query
def vector_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariance of all pairs of the vectors' numbers, from products summed in blocks of rows."""
    m = decompose.moments(embedding_rows(spark, sf_dir))
    rows = [(i + 1, j + 1, m.n, float(m.cov[i, j])) for i in range(len(m.mean)) for j in range(i, len(m.mean))]
    return spark.createDataFrame(rows, "i int, j int, n long, cov double").select("i", "j", "n", r6("cov"))


@query
def principal_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector on the first three principal components."""
    rows = embedding_rows(spark, sf_dir)
    c = decompose.principal_components(rows, 3)
    return decompose.projected(rows, c.axes, c.mean).select("id", *[r6(F.col("vec")[k], f"c{k + 1}") for k in range(3)])


@query
def sphered_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared length of each vector after sphering."""
    rows = embedding_rows(spark, sf_dir)
    m = decompose.moments(rows)
    got = decompose.projected(rows, decompose.sphering(rows), m.mean)
    return got.select("id", r6(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x), "length2"))


@query
def kmeans_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of each vector after Lloyd's algorithm from the first ten."""
    rows = embedding_rows(spark, sf_dir)
    return decompose.clustered(rows, decompose.kmeans(rows, 10)).select("id", "cluster", r6("d2"))


@query
def linked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merges of average linkage among the vectors of each label, by Euclidean distance."""
    v = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return linkage.vector_linkage(v, ["label"]).select("label", "a", "b", r6("height"), "size")


# ------------------------------------------------------------------ pairs


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_segments(spark, sf_dir).withColumn("burst_data", F.col("burst_data").cast("array<double>"))


def stored_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments in the width of their table, half the bytes where they are sent to many tasks."""
    return table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("burst_id"), F.col("embedding").alias("burst_data"))


@query
def pair_similarity_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.pair_similarity(stored_segments(spark, sf_dir), ["label"], "xcorr").select("label", "a", "b", r6("sim"))


@query
def pair_similarity_coeff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.pair_similarity(stored_segments(spark, sf_dir), ["label"], "xcorr_coeff").select("label", "a", "b", r6("sim"))


@query
def normalized_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = similarity.prepare(segments(spark, sf_dir), 4, 100)
    return s.select("burst_id", F.posexplode("burst_data").alias("pos", "x")).select("burst_id", F.col("pos").cast("long").alias("pos"), r6("x"))


@query
def dtw_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.pair_similarity(stored_segments(spark, sf_dir), ["label"], "dtw", window=3).select("label", "a", "b", r6("sim"))


@query
def pair_vector_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.pair_similarity(stored_segments(spark, sf_dir), ["label"], "xcorr", place=True).select("label", "a", "b", "pos")


@query
def nearest_episode_to_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    sp = spans(spark, sf_dir).withColumn("n_pairs", (F.col("o_orderkey") * 37) % 2000)
    e = similarity.nearest_episode(sp, ["o_custkey"], F.lit(9500), "a", "b")
    return similarity.preferred_episode(e, ["o_custkey"], tie=["o_orderkey"]).select("o_custkey", "o_orderkey", "distance", "side")


@query
def padded_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).select("burst_id", similarity.pad(F.col("burst_data"), 40, 2).alias("x"))
    return s.select("burst_id", F.posexplode("x").alias("pos", "x")).select("burst_id", F.col("pos").cast("long").alias("pos"), r6("x"))


# ------------------------------------------------------------------ regions


@query
def roi_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    vox = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("voxel"), F.lit(True).alias("inside"), F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment", F.col("c_acctbal").alias("power"))
    vox = vox.join(F.broadcast(n), "n_nationkey").withColumnRenamed("n_regionkey", "tissue_code")
    rois = r.select(F.col("r_regionkey").alias("tissue_code"), F.col("r_name").alias("roi"))
    m = sourcespace.region_mean(vox.select("voxel", "c_mktsegment", "power"), vox.select("voxel", "inside", "tissue_code"), rois, ["c_mktsegment"], skip=["AFRICA"])
    wide = sourcespace.wide_regions(m, ["c_mktsegment"], "power", ["AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"])
    return wide.select("c_mktsegment", r6("AMERICA", "america"), r6("ASIA", "asia"), r6("EUROPE", "europe"), r6(F.col("`MIDDLE EAST`"), "middle_east"))


@query
def colour_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = samples(spark, sf_dir).groupBy("channel", "user_id").agg(F.avg("v").alias("power"))
    return sourcespace.colour_limits(m, ["channel"], "power").select("channel", "user_id", r6("power"), r6("c_lo"), r6("c_hi"))


@query
def top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = samples(spark, sf_dir).select(F.col("user_id").alias("voxel"), F.col("v").alias("power"))
    return sourcespace.top_voxels(p, 20).select("voxel", r6("power"))


# ------------------------------------------------------------------ names and JSON


@query
def name_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("name", F.concat(F.lit("mgh_"), F.col("c_custkey").cast("string"), F.lit("_1_0_20000101"), F.when(F.col("c_custkey") % 2 == 0, "T").otherwise("_"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")))
    p = names.parse_name(F.col("name"))
    return c.select("c_custkey", names.patient_id(F.col("name")).alias("patient"), names.drop_first_mark(F.col("name")).alias("short"), p["hospital"].alias("hospital"), p["number"].cast("long").alias("number"), p["time"].alias("time"))


@query
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    back = F.from_json(F.to_json(F.from_json("props", "k bigint")), "k bigint")
    return e.select("event_id", back["k"].alias("k"))


@query
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    a, b = (e.where(F.col("event_type") == t).select("user_id").distinct() for t in ("click", "purchase"))
    parts = {"both": a.intersect(b), "either": a.union(b).distinct(), "first_only": a.subtract(b)}
    out = [d.agg(F.count("*").alias("n"), F.sum("user_id").alias("total")).select(F.lit(k).alias("op"), "n", "total") for k, d in parts.items()]
    return out[0].union(out[1]).union(out[2])


# ------------------------------------------------------------------ kernels without SQL


@query
def welch_bandpower(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.band_powers(samples(spark, sf_dir), ["user_id"], 20.0, 32, {"low": (0.5, 2.0), "high": (4.0, 8.0)})


@query
def zero_phase_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).select("user_id", "i", "v")
    return signal.clean_filters(s, ["user_id"], 20.0, (0.5, 4), (5, 6, 4), (8, 4))


@query
def resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.resample(samples(spark, sf_dir).select("user_id", "i", "v"), ["user_id"], 3, 2)


@query
def morlet_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trials(spark, sf_dir).withColumn("n", F.count("*").over(W.partitionBy("user_id", "trial"))).where("n = 8")
    return signal.time_frequency(t.select("user_id", "trial", "t", "v"), ["user_id"], "trial", 20.0, [2.0, 5.0])


@query
def champagne_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rng = np.random.default_rng(3)
    lead = rng.standard_normal((5, 12))
    s = samples(spark, sf_dir).groupBy("user_id", "channel", F.floor((F.col("i") - 1) / 5).alias("i")).agg(F.avg("v").alias("v"))
    chans = {c: k for k, c in enumerate(("click", "purchase", "error", "signup", "view"))}
    known = F.lit(-1)
    for c, k in chans.items():
        known = F.when(F.col("channel") == c, k).otherwise(known)
    grid = s.select("user_id", "i").distinct().withColumn("sensor", F.explode(F.sequence(F.lit(0), F.lit(4))))
    s = grid.join(s.withColumn("sensor", known).groupBy("user_id", "i", "sensor").agg(F.avg("v").alias("v")), ["user_id", "i", "sensor"], "left").fillna(0.0, ["v"])
    est = sourcespace.localize(s, ["user_id"], lead, list(range(12)), steps=20)
    vox = spark.range(12).select(F.col("id").cast("int").alias("voxel"), F.lit(True).alias("inside"), (F.col("id") % 3 + 1).cast("int").alias("tissue_code"))
    rois = spark.createDataFrame([(1, "Other"), (2, "left"), (3, "right")], "tissue_code int, roi string")
    return sourcespace.region_mean(est, vox, rois, ["user_id"])


from . import recordings  # noqa: E402, F401  registers its queries too
