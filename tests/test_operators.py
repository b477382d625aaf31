"""Operators against worked examples and brute force."""

from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quiescent import schema
from quiescent.functions import kernels, names
from quiescent.operators import detect, events, knn, montage, prep, ranges, recursive, reject, signal, similarity, sourcespace, stats, timeline
from quiescent.params import DetectParams, LshParams, NoisyChannelParams
from quiescent.sources import synthetic


def idx(spark, values, key="a"):
    return spark.createDataFrame([(key, i) for i in values], "k string, i long")


@pytest.mark.parametrize(
    ("values", "tol", "want"),
    [
        ([5, 6, 7, 20, 21, 22, 23, 60, 61], 1, [(5, 7), (20, 23), (60, 61)]),
        ([5, 6, 8, 10], 2, [(5, 10)]),
        ([], 1, []),
        ([1, 3, 6], 2, [(1, 3), (6, 6)]),
    ],
)
def test_index_ranges(spark, values, tol, want):
    got = ranges.index_ranges(idx(spark, values), ["k"], tol=tol).collect()
    assert sorted((r.start_idx, r.end_idx) for r in got) == want


def test_suppression_ratio_worked(spark):
    z = [1, 0, 0, 1, 1, 1, 0, 0]
    df = spark.createDataFrame([("r", i + 1, x, int(i + 1 == 3)) for i, x in enumerate(z)], "k string, i long, z int, art int")
    got = [r.bsr for r in recursive.suppression_ratio(df, ["k"], 4).orderBy("i").collect()]
    assert np.allclose(got, [0, 1 / 2, 2 / 3, 1 / 2, 1 / 2, 1 / 4, 1 / 4, 1 / 2])
    got = [r.bsr for r in recursive.suppression_ratio(df, ["k"], 4, artifact="art").orderBy("i").collect()]
    assert [x is None for x in got] == [False, False, True, True, True, True, False, False]


def naive_ema(x, beta):
    mu, s, out = x[0], 0.0, []
    for v in x:
        mu = beta * mu + (1 - beta) * v
        s = beta * s + (1 - beta) * (v - mu) ** 2
        out.append((mu, s))
    return np.array(out)


@pytest.mark.parametrize("beta", [0.3, 0.8, 0.953])
def test_ema_forms_agree(spark, beta):
    rng = np.random.default_rng(1)
    x = {k: rng.standard_normal(n) * 10 for k, n in (("a", 700), ("b", 1), ("c", 257))}
    df = spark.createDataFrame([(k, i + 1, float(v)) for k, xs in x.items() for i, v in enumerate(xs)], "k string, i long, v double")
    blocks = recursive.ema_variance(df, ["k"], beta=beta).toPandas()
    grouped = recursive.ema_variance_grouped(df, ["k"], "i", "v", beta).toPandas()
    for k, xs in x.items():
        want = naive_ema(xs, beta)
        for got in (blocks, grouped):
            g = got[got.k == k].sort_values("i")
            assert np.allclose(g[["mu", "var"]].to_numpy(), want, rtol=1e-9, atol=1e-9)
        m, v = recursive.ema_variance_kernel(xs, beta)
        assert np.allclose(np.c_[m, v], want)


def test_vote_rules(spark):
    rows = [("a", c, z) for c, z in zip("pqrst", (1, 1, 1, 0, 0), strict=True)] + [("b", c, z) for c, z in zip("pq", (1, 1), strict=True)]
    df = spark.createDataFrame(rows, "k string, c string, z int")
    got = {r.k: r.z for r in detect.channel_vote(df, ["k"], 5).collect()}
    assert got == {"a": 1, "b": None}
    two = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 0), ("c", 1), ("c", None)], "k string, z int")
    assert {r.k: r.z for r in detect.channel_vote(two, ["k"], 2).collect()} == {"a": 1, "b": 0, "c": 0}


def test_gap_fill_cases():
    nan = float("nan")
    f = lambda x: recursive.fill_gaps_kernel(np.array(x, float)).tolist()
    assert f([1, 2, 3, nan, nan, 4]) == [1, 2, 3, 2, 3, 4]
    assert f([1, nan, nan, 4, 5]) == [1, 1, 4, 4, 5]
    assert f([1, nan, nan, nan, nan, nan, 2]) == [1, 1, 1, 1, 2, 2, 2]
    assert all(map(math.isnan, f([nan, nan])))


def test_detect_end_to_end(spark):
    s = synthetic.recording(spark, "r", ["p", "q", "r", "s"], 120, 20.0, 10.0, 3.0)
    p = DetectParams(srate=20.0, ratio_window=20.0, min_episode=30.0, min_quiet_time=0.2)
    labels, eps, bursts = detect.detect(s, p)
    assert labels.count() == 2400 and eps.count() >= 1
    b = bursts.toPandas()
    assert len(b) >= 4 and (b.end_idx >= b.start_idx).all()
    r = labels.where("bsr is not null").agg(F.min("bsr"), F.max("bsr")).first()
    assert 0 <= r[0] <= r[1] <= 1


def test_range_joins_match_brute_force(spark):
    rnd = random.Random(3)
    rs = [(k, a, a + rnd.randint(0, 300)) for k in "ab" for a in (rnd.randint(1, 2000) for _ in range(30))]
    ps = [(k, i) for k in "ab" for i in range(1, 2400, 7)]
    r = spark.createDataFrame(rs, "k string, start_idx long, end_idx long")
    p = spark.createDataFrame(ps, "k string, i long")
    want = sorted((k, i, a, b) for k, i in ps for kk, a, b in rs if k == kk and a <= i <= b)
    for bucket in (10, 4096):
        got = sorted((x.k, x.i, x.start_idx, x.end_idx) for x in ranges.points_in_ranges(p, r, ["k"], bucket=bucket).collect())
        assert got == want
    inside = {(k, i) for k, i, _, _ in want}
    assert {(x.k, x.i) for x in ranges.points_in_ranges(p, r, ["k"], how="left_anti").collect()} == set(ps) - inside
    merged = sorted((x.k, x.start_idx, x.end_idx) for x in ranges.merge_regions(r, ["k"], gap=0).collect())
    cover = lambda rr: {(k, i) for k, a, b in rr for i in range(a, b + 1)}
    assert cover(merged) == cover(rs)
    assert all(x[0] != y[0] or x[2] < y[1] for x, y in zip(merged, merged[1:], strict=False))


def test_excise_moves_events(spark):
    s = spark.createDataFrame([("a", i) for i in range(1, 11)], "k string, i long")
    bad = spark.createDataFrame([("a", 3, 4), ("a", 8, 8)], "k string, start_idx long, end_idx long")
    kept = ranges.excise(s, bad, ["k"]).orderBy("i").collect()
    assert [r.old_i for r in kept] == [1, 2, 5, 6, 7, 9, 10]
    ev = spark.createDataFrame([("a", "x", float(i)) for i in (2, 3, 6, 10)], "k string, type string, latency double")
    got = sorted((r.type, r.latency) for r in ranges.shift_events(ev, bad, ["k"]).collect())
    assert got == [("boundary", 2.5), ("boundary", 5.5), ("x", 2.0), ("x", 4.0), ("x", 7.0)]


def test_excise_counts_each_channel(spark):
    s = spark.createDataFrame([("a", c, i) for c in "pq" for i in range(1, 6)], "k string, channel string, i long")
    bad = spark.createDataFrame([("a", 2, 2)], "k string, start_idx long, end_idx long")
    got = ranges.excise(s, bad, ["k"]).groupBy("channel").agg(F.max("i").alias("m")).collect()
    assert {r.channel: r.m for r in got} == {"p": 4, "q": 4}


def test_equal_ranges(spark):
    df = spark.createDataFrame([("a", 1, 0, 9), ("a", 2, 0, 9), ("a", 3, 2, 3)], "k string, id int, s long, e long")
    one = {r.id for r in ranges.contained_ranges(df, ["k"], "id", "s", "e").collect()}
    both = {r.id for r in ranges.contained_ranges(df, ["k"], "id", "s", "e", mutual=True).collect()}
    assert one == {2, 3} and both == {1, 2, 3}


def test_event_helpers(spark):
    ev = spark.createDataFrame([("d", i, t, float(i)) for i, t in enumerate("abcab")], "k string, event_id long, type string, latency double")
    assert events.add_events(ev, ev.select("k", "event_id").withColumn("note", F.lit("n"))).columns[-1] == "note"
    assert events.edit_field(ev, "type").columns == ["k", "event_id", "latency"]
    edited = events.edit_field(ev, "type", F.lit("z"), F.col("latency") > 3)
    assert [r.type for r in edited.orderBy("event_id").collect()] == ["a", "b", "c", "a", "z"]
    nested = events.nest_by_epoch(ev.withColumn("epoch", F.lit(1)), ["k"])
    assert events.unnest(nested, ["k"]).count() == 5
    r = spark.range(1).select(events.point_to_ms(F.lit(51.0), 100.0).alias("ms"), events.ms_to_point(F.lit(500.0), 100.0).alias("p")).first()
    assert (r.ms, r.p) == (500.0, 51.0)
    s = spark.createDataFrame([(1, 0.5), (2, 1.5)], "i long, v double")
    both, e2 = events.merge_datasets(s, s, 2, ev.drop("k"), ev.drop("k"), "m")
    assert both.agg(F.max("i")).first()[0] == 4 and e2.where("type = 'boundary'").first().latency == 2.5


def test_names(spark):
    df = spark.createDataFrame([("mgh_12_1_0_20000101_111111",), ("CA_BIDMC_25_1_20150518_003841",), ("ynh_115_1_0_20140224T080129",), ("odd",)], "n string")
    n = F.col("n")
    r = df.select(names.patient_id(n).alias("p"), names.two_tokens(n).alias("two"), names.parse_name(n).alias("x"), names.name_timestamp(n).alias("ts"), names.drop_first_mark(n).alias("d")).collect()
    assert [x.p for x in r][:2] == ["mgh_12", "CA_BIDMC_25"] and r[1].two == "CA_BIDMC"
    assert tuple(r[0].x) == ("mgh", 12, 1, 0, "20000101", "111111") and r[2].x.time == "080129" and r[3].x is None
    assert str(r[0].ts) == "2000-01-01 11:11:11" and r[0].d == "mgh12_1_0_20000101_111111"
    k = spark.createDataFrame([("a_b_10_20_3",)], "k string").select(names.burst_key(F.col("k")).alias("b")).first().b
    assert (k.rec_id, k.start, k.end, k.ord) == ("a_b", 10, 20, 3)
    o = spark.createDataFrame([(i,) for i in (1, 2, 3, 5, -1)], "c int").select(names.good_outcome(F.col("c")).alias("g")).collect()
    assert [x.g for x in o] == [True, True, False, False, None]
    order = [r.n for r in spark.createDataFrame([("f10",), ("f9",), ("f1",)], "n string").orderBy(names.natural_key(F.col("n"))).collect()]
    assert order == ["f1", "f9", "f10"]


def test_timeline_example(spark):
    info = spark.createDataFrame([("bi2", "a", "20130927_100601", 7811840), ("bi2", "b", "20130927_205703", 1000)], "sid string, name string, t string, nsamples long")
    info = info.withColumn("ts", F.to_timestamp_ntz("t", F.lit("yyyyMMdd_HHmmss")))
    got = {r.name: (r.start, r.end) for r in timeline.place_recordings(info, 200.0).collect()}
    assert got == {"a": (0, 7811840), "b": (7812400, 7813400)}


def test_offsets_and_filters(spark):
    rec = spark.createDataFrame([("r1",), ("r2",)], "name string")
    off = spark.createDataFrame([("x_r1_y", 5.0)], "f string, t double")
    got = {r.name: r.t for r in timeline.offset_by_name(rec, off, "name", "f", "t", contains=True).collect()}
    assert got == {"r1": 5.0, "r2": None}
    assert timeline.exclude(rec, rec.where("name = 'r1'"), "name").count() == 1
    t = spark.createDataFrame([("a", True, None), ("b", False, None), ("c", True, True)], "n string, g boolean, c boolean")
    assert {r.n for r in timeline.reliable_time(t, "g", "c").collect()} == {"b", "c"}
    assert [r.sid for r in timeline.sorted_subjects(spark.createDataFrame([("mgh10",), ("bi2",), ("mgh9",)], "sid string")).collect()] == ["bi2", "mgh9", "mgh10"]
    assert timeline.limit_subjects(t.withColumn("s", F.col("n")), "s", 2).count() == 2


def test_identity_neighbours(spark):
    """Unit vectors: scaled copies find their own, by exact search and by hashing."""
    d = 80
    pts = synthetic.identity_points(spark, d).withColumn("label", F.when(F.col("id") == 21, 0).otherwise(1))
    q = pts.where("id = 21").select((F.col("id") + 1000).alias("qid"), F.transform("vec", lambda x: x * 2.0).alias("qvec"))
    q = q.union(pts.where("id = 21").select((F.col("id") + 2000).alias("qid"), F.transform("vec", lambda x: x * 1.5).alias("qvec")))
    p = LshParams()
    fam, inner = knn.AxisHash((-5.0,) * d, (5.0,) * d), knn.SignHash(d)
    exact = knn.exact_knn(pts, q, 1).collect()
    two = knn.slsh_knn(pts, q, knn.TwoLayers(fam, inner, p.m_out, p.l_out, p.m_in, p.l_in, p.alpha), 1).collect()
    assert {r.qid: r.id for r in exact} == {1021: 21, 2021: 21}
    assert {r.qid: r.id for r in two} == {1021: 21, 2021: 21}
    v = knn.vote(knn.exact_knn(pts, q, 1), pts.select("id", "label")).collect()
    assert {r.pred for r in v} == {0}


def test_vote_ties_and_metrics(spark):
    n = spark.createDataFrame([(1, i) for i in range(6)] + [(2, i) for i in range(7)], "qid long, id long")
    lab = spark.createDataFrame([(0, 1)] + [(i, 0) for i in range(1, 7)], "id long, label int")
    assert {r.qid: r.pred for r in knn.vote(n, lab).collect()} == {1: 1, 2: 0}
    m = knn.metrics(spark.createDataFrame([(0, 0), (0, 0), (1, 1), (0, 1)], "label int, pred int")).first()
    assert m.accuracy == 0.75 and m.recall == 1.0 and abs(m.mcc - 2 / math.sqrt(12)) < 1e-12
    m = knn.metrics(spark.createDataFrame([(0, 0)], "label int, pred int")).first()
    assert (m.recall, m.mcc) == (-2.0, -2.0)


def test_pairs_match_plain_loops(spark):
    rng = np.random.default_rng(0)
    data = [(g, i, rng.standard_normal(rng.integers(5, 12)).tolist()) for g in (1, 2) for i in range(9)]
    df = spark.createDataFrame(data, "g int, burst_id long, burst_data array<double>")

    def dtw(x, y, w):
        w = max(w, abs(len(x) - len(y)))
        c = np.full((len(x) + 1, len(y) + 1), np.inf)
        c[0, 0] = 0
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                if abs(i - j) <= w:
                    c[i, j] = abs(x[i - 1] - y[j - 1]) + min(c[i - 1, j], c[i, j - 1], c[i - 1, j - 1])
        return c[-1, -1]

    by = {(g, i): np.array(v) for g, i, v in data}
    for metric, fn in (("dtw", lambda x, y: dtw(x, y, 3)), ("xcorr", lambda x, y: np.correlate(x, y, "full").max())):
        got = similarity.pair_similarity(df, ["g"], metric, window=3, tile=4).collect()
        assert len(got) == 2 * 36
        for r in got:
            assert r.a < r.b and abs(r.sim - fn(by[r.g, r.a], by[r.g, r.b])) < 1e-9
    same = spark.createDataFrame([(1, 1, [1.0, 2.0, -1.0]), (1, 2, [1.0, 2.0, -1.0])], "g int, burst_id long, burst_data array<double>")
    assert abs(similarity.pair_similarity(same, ["g"], "xcorr_coeff").first().sim - 1) < 1e-12
    assert similarity.pair_similarity(same, ["g"], "dtw").first().sim == 0
    assert similarity.pair_similarity(same.limit(1), ["g"], "dtw").count() == 0


def test_montage(spark):
    s = spark.createDataFrame([("r", 1, "EEG Fp1-Ref1", 3.0), ("r", 1, "T7", 2.0), ("r", 1, "eeg fp2", 1.0), ("r", 1, "ECG", 9.0)], "rec_id string, i long, channel string, v double")
    out = {r.channel: r.v for r in montage.standardize_channels(s).collect()}
    assert len(out) == 19 and out["Fp1"] == 3.0 and out["T3"] == 2.0 and out["Fp2"] == 1.0 and out["O2"] == 0.0
    assert montage.bipolar(montage.standardize_channels(s)).count() == 18
    inv = montage.invert_sites(spark.createDataFrame([("/x/ynh_1", 2.0), ("/x/mgh", 2.0)], "path string, v double")).collect()
    assert [r.v for r in inv] == [-2.0, 2.0]
    pos = spark.createDataFrame([("a", 1.0, 2.0, 2.0)], "label string, x double, y double, z double")
    back = montage.to_cartesian(montage.to_spherical(pos)).first()
    assert np.allclose([back.x, back.y, back.z], [1, 2, 2])
    turned = montage.rigid_transform(pos, (0.0, 0.0, math.pi / 2)).first()
    assert np.allclose([turned.x, turned.y, turned.z], [-2, 1, 2])
    b = spark.createDataFrame([("p", 1.0, 2.0, 2.5), ("q", 9.0, 9.0, 9.0)], "label string, x double, y double, z double")
    assert montage.closest_channels(pos, b).first().b == "p"
    w = montage.weight_table(spark, np.array([[0.5, 0.5]]), ["m"], ["Fp1", "Fp2"])
    assert montage.combine(montage.standardize_channels(s), w, ["rec_id", "i"]).first().v == 2.0


def test_statistics_edges(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 2.0)], "k string, x double, y double")
    assert stats.paired_t(df, ["k"], "x", "y").first().t is None
    q = stats.hazen_quantiles(spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "v double"), [], "v", [0.0, 0.5, 1.0]).orderBy("p").collect()
    assert [r.q for r in q] == [1.0, 2.0, 3.0]
    m = stats.Standardizer(robust=True).fit(df, "x")
    assert m.transform(df, "x").first().z is None
    assert abs(stats.inverse_normal(0.975) - 1.959964) < 1e-5 and stats.d_prime(9, 1, 1, 9) > 2
    b = stats.bootstrap_rows(spark.range(5).withColumn("k", F.lit(1)), ["k"], "id", 3).groupBy("replicate").count().collect()
    assert [r["count"] for r in b] == [5, 5, 5]


def test_validate(spark):
    df = spark.createDataFrame([("r", "c", 1, 0.5)], "rec_id string, channel string, i long, v double")
    assert schema.validate(df, schema.SAMPLES) is df
    with pytest.raises(ValueError, match="v: missing"):
        schema.validate(df.drop("v"), schema.SAMPLES)


def test_source_finds_the_active_voxel(spark):
    rng = np.random.default_rng(4)
    lead = rng.standard_normal((19, 50))
    course = np.sin(np.arange(60) / 3)
    y = np.outer(lead[:, 17], course) + 0.01 * rng.standard_normal((19, 60))
    df = spark.createDataFrame([("b", s, i, float(y[s, i])) for s in range(19) for i in range(60)], "k string, sensor int, i int, v double")
    top = sourcespace.localize(df, ["k"], lead, list(range(50)), steps=30).orderBy(F.desc("power")).first()
    assert top.voxel == 17 and top.status == "ok"
    lf = spark.createDataFrame([(s, v, 0, float(lead[s, v])) for s in range(3) for v in range(4)], "sensor int, voxel int, axis int, w double")
    m, vox = sourcespace.lead_matrix(lf)
    assert np.allclose(m, lead[:3, :4]) and vox == [0, 1, 2, 3]
    grid = spark.createDataFrame([(1, 0.2, 0.0, 0.0)], "point int, x double, y double, z double")
    vt = spark.createDataFrame([(7, 0.0, 0.0, 0.0), (8, 1.0, 0.0, 0.0)], "voxel int, x double, y double, z double")
    assert sourcespace.nearest_voxels(grid, vt, 1.0).first().voxel == 7


def test_noisy_channel_is_found_and_rebuilt(spark):
    rng = np.random.default_rng(2)
    names_ = [f"c{i}" for i in range(10)]
    ang = np.linspace(0, 2 * np.pi, 10, endpoint=False)
    pos = {n: (float(np.cos(a)), float(np.sin(a)), 0.3) for n, a in zip(names_, ang, strict=True)}
    base = np.sin(np.arange(400) / 7)
    x = np.array([base * (1 + 0.1 * np.cos(a)) + 0.02 * rng.standard_normal(400) for a in ang])
    x[3] = 40 * rng.standard_normal(400)
    df = spark.createDataFrame([("r", n, i + 1, float(x[c, i])) for c, n in enumerate(names_) for i in range(400)], "rec_id string, channel string, i long, v double")
    flags = {r.channel: r.bad for r in prep.noisy_channels(df, ["rec_id"], 100.0, NoisyChannelParams(ransac_window=2.0)).collect()}
    assert flags["c3"] and sum(flags.values()) == 1
    fixed = prep.interpolate(df, ["rec_id"], ["c3"], pos).where("channel = 'c3'").orderBy("i").toPandas().v.to_numpy()
    assert np.corrcoef(fixed, base)[0, 1] > 0.95
    ok = prep.clean_blocks(df, ["rec_id"], 100.0, 200)
    assert ok.count() == 4000 and ok.where("not ok").count() == 0
    h = prep.huber_reference(df, ["rec_id"], 200)
    assert h.where("channel = 'c0'").agg(F.stddev("v")).first()[0] < 0.5


def test_rejection_helpers(spark):
    df = spark.createDataFrame([("a", 1, True, False), ("a", 2, False, False)], "k string, trial int, f boolean, g boolean")
    assert [r.reject for r in reject.any_flag(df, ["f", "g"]).orderBy("trial").collect()] == [True, False]
    left = reject.drop_rejected(df, reject.any_flag(df, ["f"]), ["k"], "trial").collect()
    assert [(r.trial, r.new_trial) for r in left] == [(2, 1)]
    psd = spark.createDataFrame([("a", t, 5.0, p) for t, p in ((1, 1.0), (2, 1.0), (3, 1000.0))], "k string, trial int, freq double, power double")
    assert {r.trial for r in reject.spectrum_reject(psd, ["k"], "trial", 1, 10, -15, 15).where("reject").collect()} == {3}


def test_two_way_filter_and_component_removal(spark):
    from quiescent.operators import signal

    t = np.arange(800) / 200
    x = np.sin(2 * np.pi * 10 * t) + np.sin(2 * np.pi * 60 * t)
    df = spark.createDataFrame([("a", i + 1, float(v)) for i, v in enumerate(x)], "k string, i long, v double")
    y = signal.two_way_fir(df, ["k"], 200.0, 5.0, 20.0).orderBy("i").toPandas().v.to_numpy()
    assert np.abs(y - np.sin(2 * np.pi * 10 * t))[150:-150].max() < 0.1
    rng = np.random.default_rng(1)
    spikes = np.zeros(1500)
    spikes[::150] = 40
    base = rng.standard_normal((3, 1500))
    m = base + np.outer([1.0, 0.6, 0.3], spikes)
    rows = [("a", c, i, float(m[k, i])) for k, c in enumerate("pqr") for i in range(1500)]
    out = signal.ica_clean(spark.createDataFrame(rows, "k string, channel string, i int, v double"), ["k"])
    assert out.agg(F.max(F.abs("v"))).first()[0] < 20


def test_permutation_test(spark):
    rows = [(i, "a" if i % 2 else "b", float(i % 2) * 5 + i % 7) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, g string, v double")
    assert stats.permutation_test(df, (), "id", "g", "a", "b", "v", 50).first().p < 0.05


def test_muscle_channel(spark):
    s = spark.createDataFrame([("r", "x", i, float(i % 3)) for i in range(1, 9)] + [("r", "emg", i, 20.0 * (i % 2)) for i in range(1, 9)], "k string, channel string, i int, v double")
    assert detect.artifact_chunks(s, ["k"], 8, 500, 1e-4, muscle="emg").first().is_artifact
    assert not detect.artifact_chunks(s, ["k"], 8, 500, 1e-4).first().is_artifact


def test_blocks_detect_the_same(spark):
    from quiescent.operators import dense

    s = synthetic.recording(spark, "r", ["p", "q", "r", "s"], 120, 20.0, 10.0, 3.0)
    s = s.unionByName(synthetic.recording(spark, "s", ["p", "q", "r", "s"], 60, 20.0, 8.0, 5.0, seed=5))
    p = DetectParams(srate=20.0, ratio_window=20.0, min_episode=30.0, min_quiet_time=0.2)
    _, _, bursts = detect.detect(s, p)
    want = sorted((r.rec_id, r.episode_start, r.episode_end, r.start_idx, r.end_idx) for r in bursts.collect())
    got = sorted(tuple(r) for r in dense.detect_blocks(dense.to_blocks(s, ["rec_id", "channel"], 500), 4, p).collect())
    assert got == want and len(got) > 4


def test_batches_hold_like_lengths(spark):
    df = spark.createDataFrame([(i, i % 5) for i in range(103)], "id long, n int")
    got = similarity.batches_by_length(df, "n", 10, "id", parts=3).toPandas()
    sizes = got.groupby("batch").id.count()
    assert len(got) == 103 and sorted(sizes) == [3] + [10] * 10 and sorted(sizes.index) == list(range(1, 12))
    spans = sorted(zip(got.groupby("batch").n.min(), got.groupby("batch").n.max(), strict=True))
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    again = similarity.batches_by_length(df.repartition(7), "n", 10, "id", parts=3).toPandas()
    assert dict(zip(got.id, got.batch, strict=True)) == dict(zip(again.id, again.batch, strict=True))


@pytest.mark.parametrize("dependent", [False, True])
def test_false_discoveries(spark, dependent):
    rnd = random.Random(3)
    rows = [(k, rnd.choice([rnd.random() ** 4, 0.01, 1.0])) for k in "ab" for _ in range(160)] + [("c", 0.9), ("a", None)]
    df = spark.createDataFrame(rows, "k string, p double")
    want = []
    for k in "abc":
        ps = sorted(x for g, x in rows if g == k and x is not None)
        c = sum(1 / i for i in range(1, len(ps) + 1)) if dependent else 1
        cut = max((x for i, x in enumerate(ps, 1) if x <= i / len(ps) * 0.1 / c), default=-1)
        want += [(k, x, x <= cut) for x in ps]
    got = sorted((r.k, r.p, r.significant) for r in stats.fdr(df, ["k"], "p", 0.1, dependent, 8).where("p is not null").collect())
    assert got == sorted(want)


def test_sources_use_whole_recordings(spark, tmp_path):
    from quiescent.plans.queries import QUERIES

    kinds = ("click", "purchase", "error", "signup", "view")
    rows = [(i, 1, kinds[i % 5], float(i % 7) if i >= 60 else 0.0) for i in range(150)]  # silent for the first 60 samples
    e = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double")
    e.withColumn("ts", F.timestamp_seconds("event_id")).write.parquet(str(tmp_path / "events.parquet"))
    got = QUERIES["champagne_roi"](spark, str(tmp_path)).collect()
    assert got and sum(r.power for r in got) > 0


def test_warping_takes_all_vectors_whole(spark, tmp_path):
    from quiescent.plans.queries import QUERIES

    rnd = random.Random(8)
    rows = [(100 + k, [float(rnd.randint(-4, 4)) for _ in range(rnd.choice((9, 12, 20)))], k % 2) for k in range(30)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))

    def dtw(x, y):
        w = max(3, abs(len(x) - len(y)))
        d = {(0, 0): 0.0}
        for i in range(1, len(x) + 1):
            for j in range(max(1, i - w), min(len(y), i + w) + 1):
                d[i, j] = abs(x[i - 1] - y[j - 1]) + min(d.get(k, math.inf) for k in ((i - 1, j), (i, j - 1), (i - 1, j - 1)))
        return d[len(x), len(y)]

    want = {(g, a, b): dtw(x, y) for a, x, g in rows for b, y, h in rows if a < b and g == h}
    assert {(r.label, r.a, r.b): r.sim for r in QUERIES["dtw_pairs"](spark, str(tmp_path)).collect()} == want


@pytest.mark.parametrize(("n", "alpha", "want"), [(10, 0.1, (2, 9)), (20, 0.2, (3, 18)), (10, 0.4, (3, 8)), (1, 0.05, (1, 1))])
def test_surrogate_interval_leaves_as_many_on_each_side(spark, n, alpha, want):
    df = spark.range(1, n + 1).select(F.col("id").cast("double").alias("s"), F.lit(1).alias("g"))
    r = stats.surrogate_interval(df, ["g"], "s", alpha).first()
    assert (r.lo, r.hi) == want


def test_observed_value_is_last_among_equal_surrogates(spark):
    df = spark.createDataFrame([(x, 5.0) for x in (1.0, 5.0, 5.0, 5.0, 9.0)], "s double, o double")
    assert abs(stats.surrogate_p(df, ["o"], "o", "s", "right").first().p - 0.25) < 1e-12


def test_flat_windows_and_exact_slopes_in_trends(spark):
    # what a line leaves of a nearly flat window is little against the least variation, however ill it fits
    rows = [(1, t, 1e-6 * (t % 2)) for t in range(1, 6)] + [(2, t, 10.0 * t) for t in range(1, 6)] + [(3, t, 9.9 * t) for t in range(1, 6)]
    df = spark.createDataFrame([(0, *r) for r in rows], "k int, trial int, t int, v double")
    got = {r.trial: r.reject for r in reject.trend_reject(df, ["k"], "trial", 5, 1, 0.0, 0.5).collect()}
    assert got == {1: True, 2: True, 3: True}
    assert {r.trial for r in reject.trend_reject(df, ["k"], "trial", 5, 1, 50.0, 0.5).where("reject").collect()} == {2}


def test_slopes_on_their_limit_are_those_of_sql(spark):
    # all rise by 80 a window but for the last bit, in which running moments of other steps differ
    windows = [(34.67, 166.61, 15.1, 8.37, 33.79), (19.33, 94.72, 128.15, 200.72, 46.33), (0.0, 40.0, 80.0, 120.0, 0.0), (0.0, 16.0, 32.0, 48.0, 64.0)]
    rows = [(0, k, t + 1, v) for k, w in enumerate(windows) for t, v in enumerate(w)]
    df = spark.createDataFrame(rows[::-1], "k int, trial int, t int, v double").repartition(7)
    got = {r.trial: r.reject for r in reject.trend_reject(df, ["k"], "trial", 5, 1, 80.0, -1.0).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE w (trial INT, t INT, v DOUBLE)")
    con.executemany("INSERT INTO w VALUES (?, ?, ?)", [r[1:] for r in rows])
    assert got == dict(con.execute("SELECT trial, abs(regr_slope(v, t) * 5) >= 80 FROM w GROUP BY trial").fetchall())
    assert got == {0: False, 1: True, 2: False, 3: True}


def test_long_segments_are_normalized_in_proportion_to_their_length(spark):
    # the mean and deviation summed anew for each sample would be 27,000 million terms
    x = np.random.default_rng(8).standard_normal(3000)
    df = spark.createDataFrame([(1, x.tolist()), (2, [5.0, 5.0]), (3, [1.0]), (4, None), (5, [])], "id int, x array<double>")
    got = {r.id: r.z for r in df.select("id", similarity.normalized(F.col("x")).alias("z")).collect()}
    assert np.allclose(got.pop(1), (x - x.mean()) / x.std(ddof=1), atol=1e-12)
    assert got == dict.fromkeys((2, 3, 4, 5))


def test_tile_pairs_are_spread_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(similarity, "TILE_PAIRS", 3)
    df = spark.createDataFrame([(0, k, [float(k), 1.0]) for k in range(40)], "label int, burst_id long, burst_data array<double>")
    got = similarity.pair_similarity(df, ["label"], "xcorr", tile=4)
    # 55 pairs of tiles, three a task; by their bytes they would be one task
    assert got.rdd.getNumPartitions() == 19
    assert got.count() == 780


def test_series_in_blocks_equal_plain_loops(spark, monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(recursive, "MARGIN", 8)
    monkeypatch.setattr(ranges, "BLOCK", 8)
    z = {k: rng.integers(0, 2, 300) if k else np.repeat(rng.integers(0, 2, 40), rng.integers(1, 12, 40)) for k in (0, 1)}
    df = spark.createDataFrame([(k, i + 1, int(v), int(rng.random() < 0.02)) for k, x in z.items() for i, v in enumerate(x)], "k int, i long, z int, art int")
    art = {(r.k, r.i): r.art for r in df.collect()}
    got = {(r.k, r.i): r.bsr for r in recursive.suppression_ratio(df, ["k"], 6, artifact="art").collect()}
    short = {(r.k, r.i): r.z for r in recursive.relabel_short_quiet(df, ["k"], 4).collect()}
    spans = sorted((r.k, r.start_idx, r.end_idx, r.n) for r in ranges.index_ranges(df.where("z = 1"), ["k"], tol=3).collect())
    want = []
    for k, x in z.items():
        on = (np.flatnonzero(x) + 1).tolist()
        runs = []
        for i in on:
            if runs and i - runs[-1][-1] <= 3:
                runs[-1].append(i)
            else:
                runs.append([i])
        want += [(k, r[0], r[-1], len(r)) for r in runs]
        for i in range(1, len(x) + 1):
            w = x[max(0, i - 6) : i]
            bad = any(art[k, j] for j in range(max(1, i - 5), i + 1))
            assert got[k, i] is None if bad else abs(got[k, i] - (1 - w.mean())) < 1e-12
            a = b = i
            while a > 1 and x[a - 2] == 0:
                a -= 1
            while b < len(x) and x[b] == 0:
                b += 1
            assert short[k, i] == (1 if x[i - 1] or b - a + 1 < 4 else 0)
    assert spans == sorted(want) and len(got) == len(short) == sum(map(len, z.values()))


def test_slow_means_over_many_blocks(spark):
    x = np.random.default_rng(5).standard_normal(4000) * 10
    df = spark.createDataFrame([(1, i + 1, float(v)) for i, v in enumerate(x)], "g int, i long, v double")
    got = recursive.ema_variance(df, ["g"], beta=0.999).orderBy("i").toPandas()
    assert np.allclose(got[["mu", "var"]].to_numpy(), np.c_[recursive.ema_variance_kernel(x, 0.999)], rtol=1e-9, atol=1e-9)


def test_permuted_labels_are_dealt_whole(spark):
    df = spark.range(200_000, 200_400).select(F.col("id"), (F.col("id") % 3).alias("x"), (F.col("id") % 2).alias("g"))
    out = stats.permuted_labels(df, "id", "x", 3, keys=("g",)).toPandas()
    for _, r in out.groupby(["replicate", "g"]):
        assert len(r) == 200 and r.id.nunique() == 200
        assert sorted(r.x) == sorted((i % 3) for i in r.id)
    assert out[out.replicate == 1].sort_values("id").x.tolist() != out[out.replicate == 2].sort_values("id").x.tolist()


def test_chunks_equal_whole_series(spark):
    rng = np.random.default_rng(6)
    x = {"a": rng.standard_normal(5000), "b": rng.standard_normal(2049)}
    df = spark.createDataFrame([(k, i + 1, float(v)) for k, xs in x.items() for i, v in enumerate(xs)], "g string, i long, v double")
    for up, down in ((3, 2), (2, 5), (1, 4), (7, 3)):
        got = signal.resample(df, ["g"], up, down, chunk=1000).toPandas()
        for k, xs in x.items():
            g = got[got.g == k].sort_values("i")
            want = kernels.resample(xs, up, down)
            assert g.i.tolist() == list(range(1, len(want) + 1)) and np.allclose(g.v, want, atol=1e-12)
    whole = signal.clean_filters(df, ["g"], 20.0, (0.5, 4), (5, 6, 4), (8, 4)).toPandas().sort_values(["g", "i"])
    parts = signal.clean_filters(df, ["g"], 20.0, (0.5, 4), (5, 6, 4), (8, 4), chunk_seconds=70.0, halo_seconds=60.0).toPandas().sort_values(["g", "i"])
    assert len(parts) == len(whole) and np.abs(parts.v.to_numpy() - whole.v.to_numpy()).max() < 1e-6


def test_many_queries_meet_all_points(spark):
    rng = np.random.default_rng(7)
    p = spark.createDataFrame([(i, rng.standard_normal(4).tolist()) for i in range(120)], "id long, vec array<double>")
    q = p.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    want = sorted(map(tuple, knn.exact_knn(p, q, 3).collect()))
    assert sorted(map(tuple, knn.exact_knn(p, q, 3, slices=2, n_queries=20_000).collect())) == want and len(want) == 18
