"""Sources, sinks and streams."""

from __future__ import annotations

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiescent.operators import signal
from quiescent.sources import edf, synthetic, tables
from quiescent.streaming import stateful

CH = ["Fp1", "F3", "O2"]


@pytest.fixture(scope="module")
def recording(spark):
    rows = [("r1", c, i + 1, 30 * math.sin(i / (5 + k)) + k) for k, c in enumerate(CH) for i in range(790)]
    return spark.createDataFrame(rows, "rec_id string, channel string, i long, v double")


def test_edf_round_trip(spark, recording, tmp_path):
    out = edf.write_edf(recording, str(tmp_path), 200).collect()
    assert [r.status for r in out] == ["ok"] and os.path.getsize(out[0].path) == out[0].bytes
    edf.register(spark)
    back = spark.read.format("edf").option("recordsPerTask", "1").load(str(tmp_path))
    j = back.join(recording.withColumnRenamed("v", "w"), ["rec_id", "channel", "i"])
    assert back.count() == 3 * 800 and j.count() == 3 * 790
    assert j.agg(F.max(F.abs(F.col("v") - F.col("w")))).first()[0] <= 200 / 4095
    some = spark.read.format("edf").option("signals", "O2").load(str(tmp_path))
    assert [r.channel for r in some.select("channel").distinct().collect()] == ["O2"] and some.first().srate == 200.0
    assert edf.read_edf_binary(spark, str(tmp_path), "F3").exceptAll(back.where("channel = 'F3'")).count() == 0
    h = edf.read_headers(spark, str(tmp_path)).first()
    assert h.n_records == 4 and [s.label for s in h.signals] == sorted(CH)
    assert edf.write_edf(recording, str(tmp_path), 200, existing=spark.createDataFrame([("r1",)], "rec_id string")).count() == 0


def test_edf_count_from_size():
    raw = edf.encode(np.zeros((1, 50)), 20, ["a"])
    h = edf.parse_header(raw)
    assert h.records_in(len(raw)) == 3 and h.records_in(len(raw) - 1) == 2
    v = np.concatenate([x for _, _, x in edf.decode(raw[h.header_bytes :], h, 0, [0])])
    assert len(v) == 60 and np.abs(v).max() <= 200 / 4095


def test_24_bit_samples():
    raw = edf.encode(np.zeros((1, 2)), 2, ["a"])
    h = edf.parse_header(b"\xffBIOSEMI" + raw[8:])
    body = b"".join(int(x).to_bytes(3, "little", signed=True) for x in (-2048, 2047))
    (_, i, v), = edf.decode(body, h, 0, [0])
    assert i.tolist() == [1, 2] and np.allclose(v, [-100, 100])


def test_text_tables(spark, tmp_path):
    (tmp_path / "p.txt").write_text("0.5 1.5 - 1\n2 3 - 0\n\n")
    pts = tables.read_points(spark, str(tmp_path / "p.txt")).orderBy("label").collect()
    assert [(r.vec, r.label) for r in pts] == [([2.0, 3.0], 0), ([0.5, 1.5], 1)]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x_Part_1.csv").write_text("burst_start_index,burst_end_index\n200,400\n")
    b = tables.read_burst_ranges(spark, str(tmp_path / "b"), 200.0, 10.0).first()
    assert (b.file, b.t_start, b.t_end) == ("x_Part_1.csv", 11.0, 12.0)
    (tmp_path / "loc.sfp").write_text("Fz  1.0 0 2\nCz\t0 0 3\n")
    assert {r.label: r.z for r in tables.read_locations(spark, str(tmp_path / "loc.sfp"), "sfp").collect()} == {"Fz": 2.0, "Cz": 3.0}
    np.arange(6, dtype="<f4").tofile(tmp_path / "m.fdt")
    m = {(r.row, r.col): r.v for r in tables.read_matrix(spark, str(tmp_path / "m.fdt"), 2).collect()}
    assert m[(1, 1)] == 0 and m[(2, 1)] == 1 and m[(1, 3)] == 4
    (tmp_path / "todo").write_text("a\n\n b \n")
    assert [r.name for r in tables.read_list(spark, str(tmp_path / "todo")).collect()] == ["a", "b"]
    (tmp_path / "info.csv").write_text("sid,csail_edf_name,timestamp,nsamples,g,c\nbi2,x,20130927_100601,5,false,\n")
    assert str(tables.read_timeline(spark, str(tmp_path / "info.csv")).first().ts) == "2013-09-27 10:06:01"
    (tmp_path / "ev.tsv").write_text("latency\ttype\n1.5\ta\n")
    assert tables.import_events(spark, str(tmp_path / "ev.tsv"), "latency double, type string", 100.0, skip=1).first().latency == 151.0


def test_episode_json(spark):
    b = spark.createDataFrame([("r", 10, 90, 12, [1.0, 2.0]), ("r", 10, 90, 40, [3.0]), ("r", 200, 300, 210, [4.0, 5.0])], "rec_id string, episode_start long, episode_end long, burst_start_index long, burst_data array<double>")
    text = tables.episodes_json(b, ["rec_id"])
    back = tables.parse_episodes(text, keep=["rec_id"])
    assert back.select(b.columns).exceptAll(b).count() == 0 and back.count() == 3
    one = spark.createDataFrame([('{"1_9": [[{"burst_start_index": 3, "burst_data": 7.5}]]}',)], "value string")
    assert tables.parse_episodes(one).first().burst_data == [7.5]
    assert "burst_data" not in tables.parse_episodes(one, indices_only=True).columns
    n = spark.createDataFrame([('"_NaN_"',), ('"-_Inf_"',), ("1.5",)], "s string").select(tables.json_value(F.col("s")).alias("x")).collect()
    assert math.isnan(n[0].x) and n[1].x == -math.inf and n[2].x == 1.5
    s = spark.createDataFrame([(float("nan"),), (2.0,)], "x double").select(tables.spell_value(F.col("x")).alias("s")).collect()
    assert [r.s for r in s] == ['"_NaN_"', "2.0"]


def test_binary_json(spark, tmp_path):
    from quiescent.sources import ubjson

    docs = [{"name": "a", "n": [1, -200, 70000, 2**40, 2**70], "x": [0.5, 1.5, -2.0, 3.25], "deep": {"t": True, "none": None, "é": [[], {}]}}, [], 1.5, "text", {"k": [1.0, 2.0]}]
    for d in docs:
        assert ubjson.decode(ubjson.encode(d)) == d
    assert ubjson.decode(b"[#i\x02N" b"i\x01T") == [1, True] and ubjson.decode(b"[$U#i\x03\x01\x02\xff") == [1, 2, 255]
    (tmp_path / "a.ubj").write_bytes(ubjson.encode(docs[0]))
    (tmp_path / "b.ubj").write_bytes(b"[i")
    import json

    got = {os.path.basename(r.path): r.value for r in ubjson.read_ubjson(spark, str(tmp_path)).collect()}
    assert json.loads(got["a.ubj"]) == docs[0] and got["b.ubj"] is None
    back = ubjson.encode_column(spark.createDataFrame([('{"a": [1, 2.5]}',), (None,)], "j string"), "j").collect()
    assert ubjson.decode(bytes(back[0].ubjson)) == {"a": [1, 2.5]} and back[1].ubjson is None


def test_sinks(spark, tmp_path, recording):
    p = str(tmp_path / "t")
    tables.write_table(spark.createDataFrame([(1, 0.25)], "global_zs int, bsr double"), p, {"bsr": "%.3f"})
    assert tables.is_done(spark, p) and not tables.is_done(spark, p + "x")
    assert "1\t0.250" in "".join(f.read_text() for f in (tmp_path / "t").glob("part*"))
    bursts = spark.createDataFrame([("r", 1, 5, 9), ("r", 2, 50, 60)], "rec_id string, episode_id int, start_idx long, end_idx long")
    tables.write_burst_csv(bursts, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).where("part = 2").first().burst_start_index == "50"
    sim = spark.createDataFrame([("xcorr", "r", 0, 500, 1, 2, 0.5), ("dtw", "r", 0, 100, 1, 2, 3.0)], "sim_fn string, rec_id string, episode_start long, episode_end long, a int, b int, sim double")
    tables.write_similarity(sim, str(tmp_path / "s"))
    assert tables.read_similarity(spark, str(tmp_path / "s"), "xcorr", 300).count() == 1
    made = []
    make = lambda: made.append(1) or recording
    tables.cached(spark, str(tmp_path / "k"), make)
    assert tables.cached(spark, str(tmp_path / "k"), make, F.col("v").isNotNull()).count() == recording.count() and len(made) == 1
    data = tables.burst_data(bursts.withColumn("rec_id", F.lit("r1")), recording.where("channel = 'F3'"), ["rec_id"]).orderBy("burst_start_index").collect()
    assert [len(r.burst_data) for r in data] == [5, 11]


def test_synthetic_is_reproducible(spark):
    a, b = (synthetic.bursts(spark, 3, 10).orderBy("burst_id").collect() for _ in range(2))
    assert a == b and len(a[0].burst_data) == 10
    g = synthetic.gaussian_points(spark, 200, 5).select(F.explode("vec").alias("x")).agg(F.avg("x"), F.stddev("x")).first()
    assert abs(g[0]) < 0.1 and abs(g[1] - 1) < 0.1


def test_chunked_filter_equals_whole(spark, recording):
    from quiescent.functions import kernels as K

    h = K.fir_sinc(20, 30.0, 200.0)
    whole = signal.apply_series(recording, ["rec_id", "channel"], lambda x: K.fir_apply(x, h))
    parts = signal.apply_chunks(recording, ["rec_id", "channel"], lambda x: K.fir_apply(x, h), 100, 20)
    j = whole.join(parts.withColumnRenamed("v", "w"), ["rec_id", "channel", "i"])
    assert parts.count() == recording.count() and j.agg(F.max(F.abs(F.col("v") - F.col("w")))).first()[0] < 1e-9
    cut = spark.createDataFrame([("r1", 400.5)], "rec_id string, latency double")
    seg = signal.fir_by_segment(recording, ["rec_id", "channel"], h, cut)
    assert seg.count() == recording.count()


def test_stream_state_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.standard_normal(60) * 5
    schema = "k string, i long, v double"
    for part in range(3):
        spark.createDataFrame([("a", i + 1, float(x[i])) for i in range(part * 20, part * 20 + 20)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in"))
    q = stateful.ema_variance_stream(stream, ["k"], "i", "v", 0.9, 10.0).writeStream.format("memory").queryName("ema_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.sql("SELECT * FROM ema_out").orderBy("i").toPandas()
    from quiescent.operators.recursive import ema_variance_kernel

    assert np.allclose(got["var"], ema_variance_kernel(x, 0.9)[1]) and len(got) == 60


def test_windows_sessions_and_served_queries(spark, tmp_path, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    ev.coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev"))
    seen = {}
    for name, df in (("w_out", stateful.windowed(stream, "ts", "1 day", "1 hour", None, ["event_type"], "value")), ("s_out", stateful.sessions(stream, "ts", "1 day", "2 hours", ["user_id"]))):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete" if name == "w_out" else "append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        seen[name] = spark.table(name)
    assert seen["w_out"].agg(F.sum("n")).first()[0] == ev.count() and seen["s_out"].count() >= 0
    got = []
    q = stateful.serve_queries(stream.select("user_id").where("value > 200"), lambda b: b.groupBy("user_id").count(), lambda d, n: got.extend(d.collect())).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(r["count"] for r in got) == ev.where("value > 200").count()
