"""Registered queries of file formats, channels, event upkeep, subjects and names, each with its SQL beside it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import names
from ..operators import averages, detect, events, montage, ranges, recursive, reject, signal, similarity, sourcespace, stats, timeline
from ..sources import edf, tables
from ..storage import new_folder
from ..streaming import stateful
from .queries import BETA, markers, query, r6, samples, spans, table, trials

#: SQL by query.
SQL: dict[str, str] = {}

E = "e AS (SELECT user_id, event_id, event_type AS channel, ts, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"
TRIALS = f"{E}, t AS (SELECT *, (i - 1) // 8 AS trial, (i - 1) % 8 + 1 AS t FROM e)"
CHAN = f"{E}, c AS (SELECT user_id, channel, avg(v) AS v FROM e GROUP BY user_id, channel)"

# ------------------------------------------------------------------ EDF

RATE, LIMIT, EDF_THRESHOLD = 10, 100.0, 150.0


def edf_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with an EDF file for each user, written in stretches of four seconds."""
    s = samples(spark, sf_dir).select(F.col("user_id").cast("string").alias("rec_id"), "channel", "i", "v", "ts")
    about = s.groupBy("rec_id").agg(F.concat(F.lit("p"), F.first("rec_id")).alias("patient"), F.date_trunc("second", F.min("ts")).alias("start"))
    folder = new_folder(spark, "edf").removeprefix("file://")
    edf.save_edf(s, folder, RATE, about, LIMIT, per_task=4)
    return folder


def edf_samples(spark: SparkSession, folder: str) -> DataFrame:
    edf.register(spark)
    return spark.read.format("edf").option("recordsPerTask", "64").load(folder).select(F.col("rec_id").cast("long").alias("user_id"), "channel", "i", "v")


@query
def edf_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's channels written to an EDF file by several tasks and read back by the data source."""
    folder = edf_files(spark, sf_dir)
    n = edf.read_headers(spark, folder).select(F.col("rec_id").cast("long").alias("user_id"), F.col("n_records").alias("records"))
    return edf_samples(spark, folder).join(n, "user_id").select("user_id", "channel", "i", (F.round("v", 6) + 0.0).alias("v"), "records")


SQL["edf_roundtrip"] = f"""WITH {E}, n AS (SELECT user_id, CAST(ceil(max(i) / {RATE}.0) AS BIGINT) AS records FROM e GROUP BY user_id), ch AS (SELECT DISTINCT user_id, channel FROM e),
g AS (SELECT user_id, channel, unnest(range(1, records * {RATE} + 1)) AS i, records FROM n JOIN ch USING (user_id)),
f AS (SELECT g.*, greatest(-{LIMIT}, least({LIMIT}, coalesce(e.v, 0::DOUBLE))) AS x FROM g LEFT JOIN e ON e.user_id = g.user_id AND e.channel = g.channel AND e.i = g.i),
d AS (SELECT *, greatest(-2048, least(2047, round_even((x + {LIMIT}) / {2 * LIMIT} * 4095 - 2048, 0))) AS dig FROM f)
SELECT user_id, channel, i, round(dig * ({2 * LIMIT}::DOUBLE / 4095) + ({LIMIT}::DOUBLE - {2 * LIMIT}::DOUBLE / 4095 * 2047), 6) + 0.0 AS v, records FROM d"""


@query
def edf_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, records and signals in the header of each user's file."""
    h = edf.read_headers(spark, edf_files(spark, sf_dir))
    size = (256 * (1 + F.size("signals"))).cast("long")
    return h.select(F.col("rec_id").cast("long").alias("user_id"), F.col("patient_id").alias("patient"), F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), size.alias("header_bytes"), "n_records", F.array_join("signals.label", ",").alias("labels"))


SQL["edf_headers"] = f"""WITH {E}, g AS (SELECT user_id, max(i) AS n, min(ts) AS ts, list_sort(list(DISTINCT channel)) AS ch FROM e GROUP BY user_id)
SELECT user_id, 'p' || user_id AS patient, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS start, CAST(256 * (1 + len(ch)) AS BIGINT) AS header_bytes, CAST(ceil(n / {RATE}.0) AS BIGINT) AS n_records, array_to_string(ch, ',') AS labels FROM g"""



@query
def edf_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From EDF files to bursts: parsed, labelled by the moving variance of each channel, and made ranges."""
    s = recursive.ema_variance(edf_samples(spark, edf_files(spark, sf_dir)), ["user_id", "channel"], "i", "v", BETA)
    return ranges.index_ranges(s.where(F.col("var") > EDF_THRESHOLD), ["user_id", "channel"], "i", 2).select("user_id", "channel", "start_idx", "end_idx", "n")


SQL["edf_bursts"] = f"""WITH RECURSIVE {SQL["edf_roundtrip"].removeprefix("WITH ").rpartition("SELECT")[0].rstrip()},
x AS (SELECT user_id, channel, i, dig * ({2 * LIMIT}::DOUBLE / 4095) + ({LIMIT}::DOUBLE - {2 * LIMIT}::DOUBLE / 4095 * 2047) AS v FROM d),
rr AS (SELECT user_id, channel, i, v::DOUBLE AS mu, 0.0::DOUBLE AS s FROM x WHERE i = 1
 UNION ALL SELECT x.user_id, x.channel, x.i, {BETA} * rr.mu + {1 - BETA!r} * x.v, {BETA} * rr.s + {1 - BETA!r} * pow(x.v - ({BETA} * rr.mu + {1 - BETA!r} * x.v), 2)
 FROM rr JOIN x ON x.user_id = rr.user_id AND x.channel = rr.channel AND x.i = rr.i + 1),
b AS (SELECT *, CASE WHEN i - lag(i) OVER w > 2 THEN 1 ELSE 0 END AS brk FROM rr WHERE s > {EDF_THRESHOLD} WINDOW w AS (PARTITION BY user_id, channel ORDER BY i)),
k AS (SELECT *, sum(brk) OVER (PARTITION BY user_id, channel ORDER BY i) AS k FROM b)
SELECT user_id, channel, min(i) AS start_idx, max(i) AS end_idx, count(*) AS n FROM k GROUP BY user_id, channel, k.k"""

# ------------------------------------------------------------------ channels

LABELS = {"click": "EEG Fp1-Ref", "view": "T7", "purchase": " cz ", "error": "ECG", "signup": "eeg O2-ref2"}


@query
def standard_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])[F.col("channel")]
    return montage.standardize_channels(samples(spark, sf_dir).withColumn("channel", raw), ["user_id"]).select("user_id", "i", "idx", "channel", "v")


SQL["standard_channels"] = f"""WITH {E}, n AS (SELECT user_id, i, v, CASE channel WHEN 'click' THEN 'Fp1' WHEN 'view' THEN 'T3' WHEN 'purchase' THEN 'Cz' WHEN 'signup' THEN 'O2' END AS channel FROM e WHERE channel <> 'error'),
m AS (SELECT unnest({list(montage.MASTER)!r}) AS channel, unnest(range(1, 20)) AS idx), g AS (SELECT DISTINCT user_id, i FROM n)
SELECT g.user_id, g.i, CAST(m.idx AS INT) AS idx, m.channel, coalesce(n.v, 0) AS v FROM g CROSS JOIN m LEFT JOIN n ON n.user_id = g.user_id AND n.i = g.i AND n.channel = m.channel"""


@query
def inverted_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.when(F.col("user_id") % 3 == 0, "/data/YNH/").when(F.col("user_id") % 3 == 1, "/data/bwh/").otherwise("/data/mgh/"), F.col("user_id").cast("string"))
    return montage.invert_sites(samples(spark, sf_dir).withColumn("path", path)).select("event_id", "v")


SQL["inverted_sites"] = "SELECT event_id, CASE WHEN user_id % 3 IN (0, 1) THEN -value ELSE value END AS v FROM events"


@query
def muscle_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.artifact_chunks(samples(spark, sf_dir), ["user_id"], 20, 250.0, 1e-4, muscle="error", muscle_std=40.0)


SQL["muscle_artifacts"] = f"""WITH {E}, c AS (SELECT user_id, channel, (i - 1) // 20 AS chunk, max(abs(v)) AS p, stddev_samp(v) AS sd FROM e GROUP BY ALL)
SELECT user_id, chunk, bool_or(CASE WHEN channel = 'error' THEN coalesce(sd > 40, false) ELSE p > 250 OR coalesce(sd < 1e-4, false) END) AS is_artifact FROM c GROUP BY user_id, chunk"""


@query
def selected_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = montage.select(samples(spark, sf_dir), {"channel": ["click", "view", "error"]}, {"user_id": [2, 4]}, {"v": (5.0, 150.0)})
    return montage.reindex(s, ["user_id"]).select("user_id", "event_id", "i")


SQL["selected_samples"] = f"""WITH {E} SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY i) AS i FROM e WHERE channel IN ('click', 'view', 'error') AND user_id NOT IN (2, 4) AND v BETWEEN 5 AND 150"""


@query
def cropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.crop(samples(spark, sf_dir), ["user_id"], 1.0, 80 / 3600, 8).select("user_id", "event_id", "i")


SQL["cropped"] = f"WITH {E}, n AS (SELECT *, max(i) OVER (PARTITION BY user_id) AS n FROM e) SELECT user_id, event_id, i FROM n WHERE i <= least(80, n) // 8 * 8"


@query
def decimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.decimate(samples(spark, sf_dir), 3).select("user_id", "event_id", "i")


SQL["decimated"] = f"WITH {E} SELECT user_id, event_id, (i - 1) // 3 + 1 AS i FROM e WHERE (i - 1) % 3 = 0"


@query
def detrended(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).select("user_id", "event_id", "i", "v")
    return signal.apply_series(s, ["user_id"], lambda x: K.linear_detrend(x[None, :])[0]).select("event_id", r6("v"))


SQL["detrended"] = f"""WITH {E}, g AS (SELECT user_id, avg(v) AS mv, avg(i) AS mi, coalesce(regr_slope(v, i), 0) AS b FROM e GROUP BY user_id)
SELECT event_id, round(v - mv - b * (i - mi), 6) AS v FROM e JOIN g USING (user_id)"""


@query
def weighted_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = samples(spark, sf_dir).groupBy("user_id", "channel").agg(F.avg("v").alias("v"))
    w = montage.weight_table(spark, np.array([[1.0, -0.5, 0.0], [0.25, 0.25, 0.5]]), ["a", "b"], ["click", "view", "purchase"])
    return montage.combine(c, w, ["user_id"]).select("user_id", "out", F.round("v", 9).alias("v"))


SQL["weighted_channels"] = f"""WITH {CHAN}, w AS (SELECT * FROM (VALUES ('a', 'click', 1.0), ('a', 'view', -0.5), ('a', 'purchase', 0.0), ('b', 'click', 0.25), ('b', 'view', 0.25), ('b', 'purchase', 0.5)) x(out, channel, w))
SELECT user_id, out, round(sum(w * v), 9) AS v FROM c JOIN w USING (channel) GROUP BY user_id, out"""


def positions(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    k = F.col(key)
    return table(spark, sf_dir, name).select(k.alias("label"), ((k * 37) % 101 - 50).cast("double").alias("x"), ((k * 53) % 97 - 48).cast("double").alias("y"), ((k * 71) % 89 + 1).cast("double").alias("z"))


def _positions(name: str, key: str) -> str:
    return f"SELECT {key} AS label, CAST(({key} * 37) % 101 - 50 AS DOUBLE) AS x, CAST(({key} * 53) % 97 - 48 AS DOUBLE) AS y, CAST(({key} * 71) % 89 + 1 AS DOUBLE) AS z FROM {name}"


@query
def turned_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = montage.rigid_transform(positions(spark, sf_dir, "customer", "c_custkey"), (0.3, -0.2, 0.5), 1.5, (1.0, -2.0, 3.0))
    return d.select("label", r6("x"), r6("y"), r6("z"))


SQL["turned_positions"] = f"""WITH p AS ({_positions("customer", "c_custkey")}), ry AS (SELECT label, x AS x0, cos(0.3) * y - sin(0.3) * z AS y1, sin(0.3) * y + cos(0.3) * z AS z1 FROM p),
rz AS (SELECT label, cos(-0.2) * x0 + sin(-0.2) * z1 AS x2, y1 AS y2, -sin(-0.2) * x0 + cos(-0.2) * z1 AS z2 FROM ry)
SELECT label, round(1.5 * (cos(0.5) * x2 - sin(0.5) * y2) + 1, 6) AS x, round(1.5 * (sin(0.5) * x2 + cos(0.5) * y2) - 2, 6) AS y, round(1.5 * z2 + 3, 6) AS z FROM rz"""


@query
def position_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = montage.to_polar(montage.to_spherical(positions(spark, sf_dir, "customer", "c_custkey")))
    back = montage.to_cartesian(montage.from_polar(d.drop("x", "y", "z", "sph_theta", "sph_phi")))
    return back.select("label", *[r6(c) for c in ("sph_theta", "sph_phi", "sph_radius", "theta", "radius", "x", "y", "z")])


SQL["position_angles"] = f"""WITH p AS ({_positions("customer", "c_custkey")}), s AS (SELECT *, degrees(atan2(y, x)) AS t, degrees(atan2(z, sqrt(x * x + y * y))) AS p FROM p)
SELECT label, round(t, 6) AS sph_theta, round(p, 6) AS sph_phi, round(sqrt(x * x + y * y + z * z), 6) AS sph_radius, round(-t, 6) AS theta, round(0.5 - p / 180, 6) AS radius, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM s"""


@query
def closest_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = montage.closest_channels(positions(spark, sf_dir, "customer", "c_custkey"), positions(spark, sf_dir, "nation", "n_nationkey"))
    return d.select("a", "b", r6("distance"))


SQL["closest_positions"] = f"""WITH a AS ({_positions("customer", "c_custkey")}), b AS ({_positions("nation", "n_nationkey")}), d AS (SELECT a.label AS a, b.label AS b, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS distance FROM a, b),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS r FROM d) SELECT a, b, round(distance, 6) AS distance FROM r WHERE r = 1"""


@query
def nearest_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = positions(spark, sf_dir, "customer", "c_custkey").withColumnRenamed("label", "point")
    return sourcespace.nearest_voxels(grid, positions(spark, sf_dir, "supplier", "s_suppkey").withColumnRenamed("label", "voxel"), 20.0).select("point", "voxel", r6("dist"))


SQL["nearest_voxels"] = f"""WITH a AS ({_positions("customer", "c_custkey")}), b AS ({_positions("supplier", "s_suppkey")}), d AS (SELECT a.label AS point, b.label AS voxel, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS dist
 FROM a JOIN b ON b.x BETWEEN a.x - 20 AND a.x + 20 AND b.y BETWEEN a.y - 20 AND a.y + 20 AND b.z BETWEEN a.z - 20 AND a.z + 20),
r AS (SELECT *, row_number() OVER (PARTITION BY point ORDER BY dist, voxel) AS r FROM d WHERE dist <= 20) SELECT point, voxel, round(dist, 6) AS dist FROM r WHERE r = 1"""


def _regions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = table(spark, sf_dir, "nation").select(F.initcap("n_name").alias("label"), F.col("n_nationkey").alias("place"))
    return n, table(spark, sf_dir, "region").select(F.col("r_name").alias("label"), F.col("r_regionkey").alias("place")).unionByName(n.select(F.upper("label").alias("label"), "place"))


@query
def matched_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return montage.match_labels(*_regions(spark, sf_dir))


SQL["matched_labels"] = "SELECT array_to_string(list_transform(string_split(n_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS a, n_name AS b FROM nation"


@query
def merged_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _regions(spark, sf_dir)
    return montage.merge_channels(a.withColumn("label", F.upper("label")), b.withColumn("place", F.col("place") + 100)).select("label", "place")


SQL["merged_labels"] = "SELECT n_name AS label, n_nationkey AS place FROM nation UNION ALL SELECT r_name, r_regionkey + 100 FROM region WHERE r_name NOT IN (SELECT n_name FROM nation)"

# ------------------------------------------------------------------ events


@query
def nested_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = markers(spark, sf_dir).withColumn("epoch", F.floor(F.col("latency") / 86400).cast("long"))
    d = events.nest_by_epoch(m, ["user_id"])
    return d.select("user_id", "epoch", F.size("events").cast("long").alias("n"), F.transform("events", lambda x: x["event_id"])[0].alias("first_id"), F.element_at("events", -1)["type"].alias("last_type"))


SQL["nested_events"] = """WITH m AS (SELECT user_id, event_id, event_type AS type, epoch_us(ts) AS l, CAST(floor(epoch_us(ts) / 1e6 / 86400) AS BIGINT) AS epoch FROM events),
g AS (SELECT user_id, epoch, list(struct_pack(l := l, id := event_id, t := type) ORDER BY l, event_id) AS x FROM m GROUP BY user_id, epoch)
SELECT user_id, epoch, CAST(len(x) AS BIGINT) AS n, x[1].id AS first_id, x[-1].t AS last_type FROM g"""


@query
def unnested_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = markers(spark, sf_dir).withColumn("epoch", F.floor(F.col("latency") / 86400).cast("long"))
    return events.unnest(events.nest_by_epoch(m, ["user_id"]), ["user_id"]).select("user_id", "epoch", "event_id", "type", "value")


SQL["unnested_events"] = "SELECT user_id, CAST(floor(epoch_us(ts) / 1e6 / 86400) AS BIGINT) AS epoch, event_id, event_type AS type, value FROM events"


@query
def added_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = markers(spark, sf_dir)
    new = m.where("value > 150").select("user_id", (F.col("event_id") + 10_000_000).alias("event_id"), F.lit("peak").alias("type"), F.col("latency").alias("latency"), F.lit(1.5).alias("duration"))
    return events.add_events(m, new).select("user_id", "event_id", "type", "value", "duration")


SQL["added_events"] = """SELECT user_id, event_id, event_type AS type, value, CAST(NULL AS DOUBLE) AS duration FROM events
UNION ALL SELECT user_id, event_id + 10000000, 'peak', NULL, 1.5::DOUBLE FROM events WHERE value > 150"""


@query
def edited_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = events.edit_field(markers(spark, sf_dir), "value", F.col("value") * 2, F.col("type") == "click")
    m = events.edit_field(events.edit_field(m, "value", rename="level"), "latency")
    return events.edit_field(m, "big", F.lit(True), F.col("level") > 100)


SQL["edited_events"] = """SELECT user_id, event_id, event_type AS type, CASE WHEN event_type = 'click' THEN value * 2 ELSE value END AS level, CASE WHEN CASE WHEN event_type = 'click' THEN value * 2 ELSE value END > 100 THEN true END AS big FROM events"""


@query
def continuous_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trials(spark, sf_dir).select("user_id", "event_id", (F.col("trial") + 1).alias("epoch"), "t")
    return events.to_continuous(t, 8).select("user_id", "event_id", "i")


SQL["continuous_samples"] = f"WITH {E} SELECT user_id, event_id, i FROM e"


@query
def merged_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks, then views, as one dataset with a boundary between them."""
    e = table(spark, sf_dir, "events")
    n = e.agg(F.max("event_id")).first()[0] or 0
    part = lambda t: e.where(F.col("event_type") == t).select(F.col("event_id").alias("i"), F.col("value").alias("v"))
    mark = lambda t: e.where((F.col("event_type") == t) & (F.col("value") > 100)).select(F.col("event_type").alias("type"), F.col("event_id").cast("double").alias("latency"))
    s, ev = events.merge_datasets(part("click"), part("view"), n, mark("click"), mark("view"), "both")
    return s.select(F.lit("sample").alias("kind"), F.col("i").cast("double").alias("at"), "v").unionByName(ev.select(F.col("type").alias("kind"), F.col("latency").alias("at"), F.col("duration").alias("v")))


SQL["merged_datasets"] = """WITH n AS (SELECT max(event_id) AS n FROM events), d AS (SELECT event_type, value, CAST(event_id + CASE WHEN event_type = 'view' THEN n ELSE 0 END AS DOUBLE) AS "at" FROM events, n WHERE event_type IN ('click', 'view'))
SELECT 'sample' AS kind, "at", value AS v FROM d UNION ALL SELECT event_type, "at", NULL FROM d WHERE value > 100 UNION ALL SELECT 'boundary', n + 0.5, 0 FROM n"""


@query
def latency_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    ms = events.point_to_ms(F.col("i"), 250.0, -200.0)
    return s.select("event_id", r6(ms, "ms"), r6(events.ms_to_point(ms, 250.0, -200.0), "point"), names.seconds_to_samples(F.col("v") / 7, 200.0).alias("samples"), r6(names.samples_to_seconds(F.col("i"), 200.0), "seconds"), F.round(names.samples_to_hours(F.col("i"), 200.0), 9).alias("hours"))


SQL["latency_units"] = f"""WITH {E} SELECT event_id, round((i - 1) / 250.0::DOUBLE * 1000 - 200, 6) AS ms, round(i::DOUBLE, 6) AS point, CAST(round(v / 7 * 200.0::DOUBLE) AS BIGINT) AS samples, round(i / 200.0::DOUBLE, 6) AS seconds, round(i / 200.0::DOUBLE / 3600, 9) AS hours FROM e"""


@query
def nearest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = markers(spark, sf_dir)
    t0 = m.agg(F.min("latency")).first()[0] or 0.0
    return m.select("event_id", sourcespace.index_at(t0, 0.5, "latency").alias("i"))


SQL["nearest_index"] = "WITH m AS (SELECT event_id, epoch_us(ts) / 1e6 AS l FROM events), t AS (SELECT min(l) AS t0 FROM m) SELECT event_id, CAST(round((l - t0) * 0.5) + 1 AS BIGINT) AS i FROM m, t"


@query
def burst_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ranges.index_ranges(samples(spark, sf_dir).where("v > 40"), ["user_id"], tol=2).withColumn("offset", F.when(F.col("user_id") % 2 == 0, F.col("user_id") * 1.5))
    return sourcespace.onset_seconds(r, 200.0, "offset").select("user_id", "start_idx", r6("t"))


SQL["burst_onsets"] = f"""WITH {E}, h AS (SELECT user_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY user_id ORDER BY i) <= 2 THEN 0 ELSE 1 END AS b FROM e WHERE v > 40)
SELECT user_id, i AS start_idx, round(i / 200.0::DOUBLE + CASE WHEN user_id % 2 = 0 THEN user_id * 1.5::DOUBLE ELSE 0 END, 6) AS t FROM h WHERE b = 1"""

# ------------------------------------------------------------------ rejection and averages


@query
def kept_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trials(spark, sf_dir)
    return reject.drop_rejected(t, reject.threshold_reject(t, ["user_id"], "trial", 0.5, 150.0), ["user_id"], "trial").select("event_id", F.col("new_trial").cast("long").alias("new_trial"))


SQL["kept_trials"] = f"""WITH {TRIALS}, g AS (SELECT *, min(v) OVER w < 0.5 OR max(v) OVER w > 150 AS bad FROM t WINDOW w AS (PARTITION BY user_id, trial)) SELECT event_id, dense_rank() OVER (PARTITION BY user_id ORDER BY trial) AS new_trial FROM g WHERE NOT bad"""


@query
def kurtosis_reject_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = reject.kurtosis_reject(trials(spark, sf_dir), ["user_id"], "trial", 3.0, trim=0.1)
    return d.select("user_id", "trial", r6("kurt"), r6("z"), "reject")


SQL["kurtosis_reject_trimmed"] = f"""WITH {TRIALS}, c AS (SELECT user_id, trial, v, avg(v) OVER (PARTITION BY user_id, trial) AS m FROM t),
g AS (SELECT user_id, trial, avg(pow(v - m, 4)) / pow(var_samp(v), 2) - 3 AS x FROM c GROUP BY user_id, trial HAVING count(*) > 1),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY x) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM g),
p AS (SELECT user_id, avg(x) AS m, stddev_samp(x) AS s FROM r WHERE r BETWEEN greatest(round(0.1::DOUBLE * n), 1) AND n - round(0.1::DOUBLE * n) GROUP BY user_id)
SELECT user_id, trial, round(x, 6) AS kurt, round((x - m) / nullif(s, 0), 6) AS z, abs((x - m) / nullif(s, 0)) > 3 AS reject FROM g LEFT JOIN p USING (user_id)"""


@query
def nan_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).withColumn("x", F.when(F.col("v") > 120, F.lit(float("nan"))).otherwise(F.col("v")))
    return s.groupBy("user_id").agg(r6(stats.nan_mean("x"), "mean"), r6(stats.nan_std("x"), "sd"))


SQL["nan_statistics"] = "SELECT user_id, round(avg(value) FILTER (value <= 120), 6) AS mean, round(stddev_samp(value) FILTER (value <= 120), 6) AS sd FROM events GROUP BY user_id"


@query
def noisy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = samples(spark, sf_dir).groupBy("user_id", "channel").agg((F.max("v") > 150).alias("peak"), (F.count("*") < 10).alias("few"))
    return averages.noisy_summary(c, ["user_id"], ["peak", "few"])


SQL["noisy_summary"] = "WITH c AS (SELECT user_id, event_type, max(value) > 150 AS peak, count(*) < 10 AS few FROM events GROUP BY ALL) SELECT user_id, count(*) AS channels, CAST(sum(peak::INT) AS BIGINT) AS peak, CAST(sum(few::INT) AS BIGINT) AS few FROM c GROUP BY user_id"


@query
def percent_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = recursive.moving_average(samples(spark, sf_dir), ["user_id"], "i", "v", 2)
    return stats.percent_variance(m, ["user_id"], "v", "avg").select("user_id", r6("pvaf"))


SQL["percent_variance"] = f"""WITH {E}, m AS (SELECT user_id, v, avg(v) OVER (PARTITION BY user_id ORDER BY i RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS a FROM e)
SELECT user_id, round(100 * (1 - var_samp(v - a) / nullif(var_samp(v), 0)), 6) AS pvaf FROM m GROUP BY user_id"""


@query
def qq_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.qq_points(samples(spark, sf_dir), "channel", "click", "view", "v", [0.1, 0.5, 0.9]).select("p", r6("qa"), r6("qb"))


SQL["qq_points"] = f"""WITH {E}, r AS (SELECT channel, v, row_number() OVER (PARTITION BY channel ORDER BY v) AS r, count(*) OVER (PARTITION BY channel) AS n FROM e WHERE channel IN ('click', 'view')),
p AS (SELECT *, unnest([0.1::DOUBLE, 0.5, 0.9]) AS p FROM r), a AS (SELECT *, greatest(1, least(n, p * n + 0.5)) AS pos FROM p),
q AS (SELECT channel, p, arg_min(v, r) + (arg_max(v, r) - arg_min(v, r)) * (any_value(pos) - floor(any_value(pos))) AS q FROM a WHERE r = floor(pos) OR r = ceil(pos) GROUP BY channel, p)
SELECT p, round(max(CASE WHEN channel = 'click' THEN q END), 6) AS qa, round(max(CASE WHEN channel = 'view' THEN q END), 6) AS qb FROM q GROUP BY p"""


@query
def strongest_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = samples(spark, sf_dir).groupBy("user_id", "channel").agg(F.avg("v").alias("m"))
    return stats.strongest_surrogate(g, "user_id", "m").select("user_id", r6("strongest"))


SQL["strongest_surrogates"] = f"WITH {CHAN} SELECT user_id, round(max(v), 6) AS strongest FROM c GROUP BY user_id"


@query
def speed_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = samples(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.sum((F.col("v") > 100).cast("int")).alias("c"), F.count_distinct("channel").alias("w"))
    return g.select("user_id", r6(averages.speed_up(F.col("n"), F.col("c"), F.col("w")), "speed_up"))


SQL["speed_up"] = "SELECT user_id, round(count(*) / nullif(count(*) FILTER (value > 100), 0) / count(DISTINCT event_type), 6) AS speed_up FROM events GROUP BY user_id"


@query
def anova2_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).where("channel in ('click', 'view', 'purchase')")
    late = (F.col("i") * 2 > F.max("i").over(W.partitionBy("user_id"))).cast("int")
    cell = s.withColumn("late", late).groupBy("user_id", "channel", "late").agg(F.avg("v").alias("v"))
    d = stats.anova2_repeated(cell, "user_id", "channel", "late", "v")
    return d.select("effect", F.round("ss", 3).alias("ss"), "df", "df_error", F.round("f", 5).alias("f"))


SQL["anova2_repeated"] = f"""WITH {E}, s AS (SELECT user_id, channel, CASE WHEN i * 2 > max(i) OVER (PARTITION BY user_id) THEN 1 ELSE 0 END AS late, v FROM e WHERE channel IN ('click', 'view', 'purchase')),
c AS (SELECT user_id AS s, channel AS a, late AS b, avg(v) AS y FROM s GROUP BY ALL), k AS (SELECT *, count(*) OVER (PARTITION BY s) AS k FROM c),
f AS (SELECT *, avg(y) OVER () AS g, avg(y) OVER (PARTITION BY s) AS ms, avg(y) OVER (PARTITION BY a) AS ma, avg(y) OVER (PARTITION BY b) AS mb, avg(y) OVER (PARTITION BY s, a) AS msa, avg(y) OVER (PARTITION BY s, b) AS msb, avg(y) OVER (PARTITION BY a, b) AS mab
  FROM k WHERE k = (SELECT count(DISTINCT a) * count(DISTINCT b) FROM c)),
t AS (SELECT count(DISTINCT s) AS n, count(DISTINCT a) AS na, count(DISTINCT b) AS nb, sum(pow(ma - g, 2)) AS ssa, sum(pow(mb - g, 2)) AS ssb, sum(pow(mab - ma - mb + g, 2)) AS ssab,
  sum(pow(msa - ms - ma + g, 2)) AS ea, sum(pow(msb - ms - mb + g, 2)) AS eb, sum(pow(y - msa - msb - mab + ms + ma + mb - g, 2)) AS eab FROM f),
x AS (SELECT 'rows' AS effect, ssa AS ss, na - 1 AS df, ea AS e, n FROM t UNION ALL SELECT 'columns', ssb, nb - 1, eb, n FROM t UNION ALL SELECT 'interaction', ssab, (na - 1) * (nb - 1), eab, n FROM t)
SELECT effect, round(ss, 3) AS ss, df, df * (n - 1) AS df_error, round((ss / df) / (e / (df * (n - 1))), 5) AS f FROM x"""

# ------------------------------------------------------------------ subjects and names


@query
def recording_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    pid = F.when(c % 3 == 0, F.concat(F.lit("CA_BIDMC_"), c.cast("string"))).otherwise(F.concat(F.lit("mgh_"), c.cast("string")))
    stamp = F.concat(F.lit("201001"), F.lpad((c % 28 + 1).cast("string"), 2, "0"), F.lit("T"), F.lpad((c % 24).cast("string"), 2, "0"), F.lit("3015"))
    start = names.name_timestamp(F.concat(pid, F.lit("_1_0_"), stamp))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", names.two_tokens(pid).alias("two"), names.patient_id(F.concat(pid, F.lit("_x"))).alias("patient"), names.hospital(pid).alias("hospital"), names.pname_to_sid(pid).alias("sid"),
        F.date_format(start, "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format(names.end_time(start, c * 100, 200.0), "yyyy-MM-dd HH:mm:ss").alias("stop"),
        names.region_name(F.concat(F.col("c_mktsegment"), F.lit(" left-side"))).alias("region"), names.good_outcome(c % 7).alias("good"),
    )


SQL["recording_names"] = """WITH n AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN 'CA_BIDMC_' || c_custkey ELSE 'mgh_' || c_custkey END AS pid, CASE WHEN c_custkey % 3 = 0 THEN 'CA_BIDMC' ELSE 'mgh' END AS h,
  make_timestamp(2010, 1, c_custkey % 28 + 1, c_custkey % 24, 30, 15.0) AS s FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'CA_BIDMC' ELSE pid END AS two, pid AS patient, h AS hospital, h || c_custkey AS sid, strftime(s, '%Y-%m-%d %H:%M:%S') AS start,
  strftime(s + to_microseconds(CAST(c_custkey * 500000 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS stop, c_mktsegment || '_left_side' AS region, CASE WHEN c_custkey % 7 IN (1, 2) THEN true WHEN c_custkey % 7 IN (3, 4, 5) THEN false END AS good FROM n"""


@query
def key_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = names.make_burst_key(F.concat(F.lit("rec_"), F.col("o_custkey").cast("string")), F.col("o_orderkey"), F.col("o_orderkey") + 25, F.col("o_orderkey") % 9)
    b, e = names.burst_key(key), names.episode_bounds(F.concat_ws("_", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")))
    return o.select("o_orderkey", b["rec_id"].alias("rec_id"), b["start"].alias("start"), b["end"].alias("stop"), b["ord"].cast("long").alias("ordinal"), e["start"].alias("first"), e["end"].alias("last"), r6(names.decibel(F.col("o_totalprice") - 50_000), "db"))


SQL["key_parts"] = """SELECT o_orderkey, 'rec_' || o_custkey AS rec_id, o_orderkey AS start, o_orderkey + 25 AS stop, o_orderkey % 9 AS ordinal, o_custkey AS first, o_orderkey AS last, CASE WHEN o_totalprice > 50000 THEN round(10 * log10(o_totalprice - 50000), 6) END AS db FROM orders"""


@query
def channel_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    newest = ("T7", "T8", "P7", "P8", "Oz")
    all_ = [*montage.MASTER, *newest]
    label = F.concat(F.when(k % 2 == 0, "EEG ").otherwise(""), F.element_at(F.array(*[F.lit(x) for x in all_]), (k % len(all_) + 1).cast("int")), F.when(k % 5 == 0, "-REF").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", montage.standard_label(label).alias("label"))


SQL["channel_labels"] = f"""SELECT p_partkey, ({[*montage.MASTER, "T3", "T4", "T5", "T6", ""]!r})[CAST(p_partkey % 24 + 1 AS INT)] AS x, nullif(x, '') AS label FROM part"""
SQL["channel_labels"] = f"WITH x AS ({SQL['channel_labels']}) SELECT p_partkey, label FROM x"


@query
def natural_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = names.natural_key(F.concat(F.lit("seg"), (F.col("p_partkey") % 4).cast("string"), F.lit("_part"), F.col("p_partkey").cast("string"), F.lit(".edf")))
    return table(spark, sf_dir, "part").select("p_partkey", k["text"].alias("text"), k["n"].alias("n"))


SQL["natural_keys"] = "SELECT p_partkey, 'seg' || p_partkey % 4 || '_part.edf' AS text, p_partkey AS n FROM part"


@query
def sorted_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    sid = F.concat(F.element_at(F.array(F.lit("bwh"), F.lit("mgh"), F.lit("ynh")), (F.col("c_custkey") % 3 + 1).cast("int")), F.col("c_nationkey").cast("string"))
    d = timeline.sorted_subjects(table(spark, sf_dir, "customer").select(sid.alias("sid")))
    # one row for each subject: their order is given as a column
    return d.withColumn("place", F.row_number().over(W.orderBy(F.regexp_extract("sid", r"^(\D*)", 1), names.number(F.col("sid")), "sid")).cast("long"))


SQL["sorted_subjects"] = """WITH s AS (SELECT DISTINCT (['bwh', 'mgh', 'ynh'])[CAST(c_custkey % 3 + 1 AS INT)] AS h, c_nationkey AS n FROM customer) SELECT h || n AS sid, row_number() OVER (ORDER BY h, n) AS place FROM s"""


@query
def first_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return timeline.limit_subjects(o, "o_custkey", 40, per_group=3, order=["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


SQL["first_subjects"] = """WITH s AS (SELECT DISTINCT o_custkey FROM orders ORDER BY o_custkey LIMIT 40), r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders WHERE o_custkey IN (SELECT o_custkey FROM s))
SELECT o_custkey, o_orderkey FROM r WHERE r <= 3"""


@query
def chosen_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return similarity.window_of(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], 2, 4).select("o_custkey", "o_orderkey")


SQL["chosen_bursts"] = "WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) SELECT o_custkey, o_orderkey FROM r WHERE r BETWEEN 2 AND 4"


@query
def length_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    sp = spans(spark, sf_dir).withColumn("len", F.col("b") - F.col("a"))
    d = similarity.batches_by_length(sp, "len", 64, "o_orderkey")
    return d.groupBy(F.col("batch").cast("long").alias("batch")).agg(F.count("*").alias("n"), F.min("len").alias("shortest"), F.max("len").alias("longest"))


SQL["length_batches"] = """WITH sp AS (SELECT o_orderkey, greatest(o_orderdate::DATE - DATE '1970-01-01', max(l_shipdate)::DATE - DATE '1970-01-01') - (o_orderdate::DATE - DATE '1970-01-01') AS len FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, o_orderkey, o_orderdate),
r AS (SELECT CAST(len AS INT) AS len, (row_number() OVER (ORDER BY len) - 1) // 64 AS b FROM sp), g AS (SELECT b, count(*) AS n, min(len) AS shortest, max(len) AS longest FROM r GROUP BY b)
SELECT row_number() OVER (ORDER BY md5(b || '|0')) AS batch, n, shortest, longest FROM g"""


@query
def big_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.big_enough(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], 10)


SQL["big_groups"] = "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 10)"


@query
def reliable_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 2 == 0).alias("guessed"), F.when(F.col("o_orderkey") % 3 < 2, F.col("o_orderkey") % 3 == 0).alias("correct"))
    out = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return timeline.exclude(timeline.reliable_time(o, "guessed", "correct"), out, "o_custkey").select("o_custkey", "o_orderkey")


SQL["reliable_recordings"] = "SELECT o_custkey, o_orderkey FROM orders WHERE (o_orderkey % 2 <> 0 OR o_orderkey % 3 = 0) AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"


def _recordings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rec = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("nation"))
    off = table(spark, sf_dir, "nation").where("n_nationkey % 3 <> 0").select(F.concat(F.when(F.col("n_nationkey") % 2 == 0, "file of ").otherwise(""), F.col("n_name")).alias("file"), (F.col("n_nationkey") * 10.0).alias("offset"))
    return rec, off


@query
def offsets_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.offset_by_name(*_recordings(spark, sf_dir), "name", "file", "offset").select("name", "offset")


SQL["offsets_equal"] = 'SELECT n_name AS name, CASE WHEN n_nationkey % 3 <> 0 AND n_nationkey % 2 <> 0 THEN n_nationkey * 10.0::DOUBLE END AS "offset" FROM nation'


@query
def offsets_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.offset_by_name(*_recordings(spark, sf_dir), "name", "file", "offset", contains=True).select("name", "offset")


SQL["offsets_contained"] = """WITH o AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'file of ' ELSE '' END || n_name AS f, n_nationkey * 10.0::DOUBLE AS "offset" FROM nation WHERE n_nationkey % 3 <> 0),
r AS (SELECT n_name AS name, "offset", row_number() OVER (PARTITION BY n_name ORDER BY length(f) NULLS FIRST, f) AS r FROM nation LEFT JOIN o ON contains(f, n_name)) SELECT name, "offset" FROM r WHERE r = 1"""


@query
def disordered_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return timeline.unordered(timeline.order_segments(o, "o_custkey", "o_orderdate", "o_orderkey"), "o_custkey")


SQL["disordered_subjects"] = """WITH r AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders) SELECT o_custkey, count(*) AS n FROM r WHERE a <> b GROUP BY 1"""


@query
def json_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, NaN and infinities written as JSON and read again."""
    s = samples(spark, sf_dir)
    x = F.when(F.col("v") > 200, F.lit(float("inf"))).when(F.col("v") > 150, F.lit(float("-inf"))).when(F.col("v") > 100, F.lit(float("nan"))).otherwise(F.col("v"))
    back = tables.json_value(tables.spell_value(x))
    kind = F.when(F.isnan("x"), "nan").when(F.abs("x") == float("inf"), F.when(F.col("x") > 0, "+").otherwise("-")).otherwise("number")
    return s.select("event_id", back.alias("x")).select("event_id", kind.alias("kind"), r6(F.when(kind == "number", F.col("x")), "x"))


SQL["json_numbers"] = "SELECT event_id, CASE WHEN value > 200 THEN '+' WHEN value > 150 THEN '-' WHEN value > 100 THEN 'nan' ELSE 'number' END AS kind, CASE WHEN value <= 100 THEN round(value, 6) END AS x FROM events"


@query
def all_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).where("n_regionkey <> 2 or c_mktsegment <> 'BUILDING'")
    rois = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("tissue_code"), F.col("r_name").alias("roi"))
    m = c.join(F.broadcast(rois), F.col("n_regionkey") == F.col("tissue_code")).groupBy("c_mktsegment", "roi").agg(F.avg("c_acctbal").alias("power"))
    return sourcespace.all_regions(m, rois, ["c_mktsegment"], "power", ["AFRICA"]).select("c_mktsegment", "roi", r6("power"))


SQL["all_regions"] = """WITH c AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 2 OR c_mktsegment <> 'BUILDING'), s AS (SELECT DISTINCT c_mktsegment FROM c)
SELECT s.c_mktsegment, r_name AS roi, round(avg(c_acctbal), 6) AS power FROM s CROSS JOIN region LEFT JOIN c ON c.c_mktsegment = s.c_mktsegment AND c.n_regionkey = r_regionkey WHERE r_name <> 'AFRICA' GROUP BY ALL"""


@query
def masked_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"), F.reverse(F.col("embedding").cast("array<double>")).alias("b"), (F.col("vec_id") % 64).cast("int").alias("n"))
    return similarity.masked_mse(e, "a", "b", "n").select("vec_id", r6("mse"))


SQL["masked_mse"] = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS a, list_reverse(embedding::DOUBLE[]) AS b, CAST(vec_id % 64 AS INT) AS n FROM embeddings)
SELECT vec_id, CASE WHEN n > 0 THEN round(list_sum(list_transform(range(1, n + 1), lambda j: pow(a[j] - b[j], 2))) / n, 6) END AS mse FROM e"""

# ------------------------------------------------------------------ streams, over the table as one batch


@query
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("type"), "value")
    w = stateful.windowed(e, "ts", "1 hour", "6 hours", "3 hours", ["type"], "value")
    return w.select(F.unix_seconds("start").alias("start"), "type", "n", r6("mean"), r6("total"))


SQL["event_windows"] = """WITH e AS (SELECT event_type AS type, value, CAST(floor(epoch_us(ts) / 10800e6) AS BIGINT) AS k FROM events), x AS (SELECT type, value, unnest([k, k - 1]) * 10800 AS start FROM e)
SELECT start, type, count(*) AS n, round(avg(value), 6) AS mean, round(sum(value), 6) AS total FROM x GROUP BY start, type"""


@query
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    return stateful.sessions(e, "ts", "1 hour", "2 hours", ["user_id"]).select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("stop"), "n")


SQL["event_sessions"] = """WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events), b AS (SELECT *, CASE WHEN t - lag(t) OVER w < 7200000000 THEN 0 ELSE 1 END AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM b) SELECT user_id, min(t) AS start, max(t) + 7200000000 AS stop, count(*) AS n FROM g GROUP BY user_id, g"""
