"""Order statistics, nearest points and the stored neighbour index against plain versions."""

from __future__ import annotations

import math
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiescent.operators import knn, montage, prep, selection, sourcespace, stats
from quiescent.operators.neighbours import NeighbourIndex
from quiescent.plans import queries as Q

# ---------------------------------------------------------------- order statistics


@pytest.mark.parametrize(("bins", "few"), [(64, 20), (selection.BINS, selection.FEW)])
def test_order_statistics(spark, bins, few):
    rnd = random.Random(bins)
    groups = {
        "ties": [rnd.randrange(4) / 2 for _ in range(300)], "wide": [math.exp(rnd.uniform(-300, 300)) * rnd.choice([-1, 1]) for _ in range(200)], "one": [7.0], "same": [2.5] * 90,
        "ends": [math.inf] * 5 + [-math.inf] * 4 + [1e308, -1e308, 0.0, -0.0] + [rnd.gauss(0, 1) for _ in range(60)], None: [rnd.gauss(0, 1) for _ in range(150)],
        "close": [1.0 + k * 2.0**-52 for k in range(100)] + [1e9], "big": [rnd.gauss(5, 2) for _ in range(1500)],
    }
    df = spark.createDataFrame([(k, 1, v) for k, vs in groups.items() for v in vs], "k string, one int, v double").repartition(5)
    ranks = lambda n: [F.lit(1), F.ceil(n / 4), F.floor((n + 1) / 2), n, F.lit(0), n + 1, F.ceil(n / 4)]
    got = {r.k: r for r in selection.order_statistics(df, ["k", "one"], "v", ranks, bins, few).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        o, n = sorted(vs), len(vs)
        want = [o[0], o[math.ceil(n / 4) - 1], o[(n + 1) // 2 - 1], o[-1], None, None, o[math.ceil(n / 4) - 1]]
        assert got[k].n == n and list(got[k]["values"]) == want, k
    whole = selection.order_statistics(df, [], "v", lambda n: [F.floor((n + 1) / 2)], bins, few).collect()
    every = sorted(v for vs in groups.values() for v in vs)
    assert len(whole) == 1 and whole[0]["values"] == [every[(len(every) + 1) // 2 - 1]]
    assert selection.order_statistics(df.where("false"), ["k"], "v", ranks).count() == 0 and selection.order_statistics(df.where("false"), [], "v", ranks).count() == 0


def test_order_statistics_beyond_broadcasts(spark, monkeypatch):
    df = spark.range(20_000).selectExpr("id % 3 as k", "cast(pmod(id * 7919, 20011) as double) as v")
    want = {r.k: r["values"] for r in selection.order_statistics(df, ["k"], "v", lambda n: [F.ceil(n / 3)], 64, 100).collect()}
    joined = []
    inside = selection._inside
    monkeypatch.setattr(selection, "_inside", lambda rows, spans, keys, n: joined.append(n) or inside(rows, spans, keys, 10**9))
    assert {r.k: r["values"] for r in selection.order_statistics(df, ["k"], "v", lambda n: [F.ceil(n / 3)], 64, 100).collect()} == want and joined


def test_no_window_has_a_group(spark):
    df = spark.range(50_000).selectExpr("id % 2 as k", "cast(hash(id) as double) as v")
    plan = stats.hazen_quantiles(df, ["k"], "v", [0.1, 0.5])._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort [" not in plan


# ---------------------------------------------------------------- nearest points


def test_every_position_counts(spark):
    one = spark.createDataFrame([("p", 12_000.0, 0.0, 0.0)], "label string, x double, y double, z double")
    many = spark.range(12_000).selectExpr("cast(id as string) as label", "cast(id as double) as x", "0.0D as y", "0.0D as z")
    assert montage.closest_channels(one, many).first()[:] == ("p", "11999", 1.0)


@pytest.mark.parametrize("cell", [None, 0.01, 50.0])
def test_nearest_points(spark, cell, monkeypatch):
    rng = np.random.default_rng(5)
    t = np.concatenate([rng.normal(0, 1, (300, 3)), rng.normal(40, 0.1, (200, 3)), np.zeros((3, 3))])
    p = np.concatenate([rng.normal(0, 5, (80, 3)), rng.normal(30, 20, (40, 3)), t[:5]])
    monkeypatch.setattr(sourcespace, "FEW_TARGETS", 10)
    df = lambda a, n: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(a)], f"{n} int, x double, y double, z double")
    bad = spark.createDataFrame([(900, None, 0.0, 0.0), (901, math.nan, 0.0, 0.0)], "id int, x double, y double, z double")
    got = sourcespace.nearest_points(df(p, "point").union(bad), df(t, "target").union(bad), cell).collect()
    d = np.sqrt(((p[:, None] - t[None]) ** 2).sum(-1))
    assert sorted((r.point, r.target) for r in got) == [(i, int(j)) for i, j in enumerate(d.argmin(1))]
    assert all(abs(r.dist - d[r.point].min()) < 1e-9 for r in got)
    assert sourcespace.nearest_points(df(p, "point"), df(t, "target").where("false"), cell).count() == 0


def test_labels_by_one_lookup(spark):
    names = ["EEG Fp1-Ref", " eeg  FP1-REF2", "t7", "P8", "Cz", "ECG", "", None, "Fp1-Ref-x"]
    df = spark.createDataFrame([(n,) for n in names], "c string").select(montage.standard_label(F.col("c")).alias("s"))
    assert [r.s for r in df.collect()] == ["Fp1", "Fp1", "T3", "T6", "Cz", None, None, None, None]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") == 0 and df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 2


def test_every_bad_channel_is_remembered(spark, monkeypatch):
    bad = spark.range(5000).select(F.concat(F.lit("c"), "id").alias("channel"), F.lit(True).alias("bad"))
    monkeypatch.setattr(prep, "noisy_channels", lambda *a, **k: bad)
    monkeypatch.setattr(prep, "interpolate", lambda samples, *a, **k: samples)
    s = spark.createDataFrame([("r", "c0", 1, 0.5)], "rec_id string, channel string, i long, v double")
    assert len(prep.robust_reference(s, ["rec_id"], 200.0, {f"c{i}": (0.0, 0.0, 1.0) for i in range(6000)})[1]) == 5000


# ---------------------------------------------------------------- hashed searches


@pytest.fixture(scope="module")
def vectors(spark):
    p, q = Q.vectors(spark, "/root/testdata/sf0.01")
    return p.select("id", "vec").cache(), q.cache()


def pairs(df):
    return sorted((r.qid, r["rank"], r.id, r.dist) for r in df.collect())


def test_recall(spark, vectors):
    p, q = vectors
    l1, cosine = knn.exact_knn(p, q, 5, "l1").cache(), knn.exact_knn(p, q, 5, "cosine")
    assert knn.recall(knn.lsh_knn(p, q, Q.AXIS, 6, 8, 5), l1) >= 0.9
    assert knn.recall(knn.lsh_knn(p, q, Q.SIGN, *Q.COSINE[:2], 5, "cosine", probes=Q.COSINE[2]), cosine) >= 0.9
    assert knn.recall(knn.slsh_knn(p, q, Q.LAYERS, 5), l1) >= 0.9
    assert knn.recall(l1, l1.where("false")) == 1.0


def test_probes(spark):
    df = spark.createDataFrame([("0110",)], "k string")
    assert df.select(knn.probed(F.col("k"), 4, 1)).first()[0] == ["0110", "1110", "0010", "0100", "0111"]
    assert df.select(knn.probed(F.col("k"), 4, 0)).first()[0] == ["0110"]
    with pytest.raises(ValueError, match="probes"):
        knn.probed(F.col("k"), 4, 2)


def test_index_grows(spark, vectors):
    p, q = vectors
    folder = tempfile.mkdtemp() + "/index"
    layers = knn.TwoLayers(Q.AXIS, Q.SIGN, 5, 4, 3, 4, 0.05, probes=1)
    index = NeighbourIndex.create(spark, folder, layers, parts=8)
    assert index.nearest(q, 3).count() == 0
    parts = [p.where("id % 5 = 1"), p.where("id % 5 > 1"), p.where("id < 0"), p.where("id % 5 = 0")]
    seen = p.where("false")
    split = []
    for k, part in enumerate(parts, 1):
        assert index.append(part) == k
        seen = seen.union(part)
        assert pairs(index.nearest(q, 3)) == pairs(knn.slsh_knn(seen, q, layers, 3))
        split.append({(r.tbl, r.key) for r in index._counts(index.version()[1]).where("split").collect()})
    assert split[0] <= split[1] <= split[2] <= split[3] and split[0]
    again = NeighbourIndex.open(spark, folder, layers)
    assert pairs(again.nearest(q, 3)) == pairs(index.nearest(q, 3)) and again.parts == 8
    with pytest.raises(ValueError, match="other layers"):
        NeighbourIndex.open(spark, folder, Q.LAYERS)
    with pytest.raises(ValueError, match="exists"):
        NeighbourIndex.create(spark, folder, layers)


def test_index_survives_a_failed_append(spark, vectors, monkeypatch):
    p, q = vectors
    index = NeighbourIndex.create(spark, tempfile.mkdtemp() + "/index", Q.LAYERS, parts=4)
    index.append(p.where("id < 300"))
    before = pairs(index.nearest(q, 3))
    with monkeypatch.context() as m:
        m.setattr(index, "_inner", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            index.append(p.where("id >= 300"))
    assert pairs(index.nearest(q, 3)) == before and index.version()[0] == 1
    other = NeighbourIndex.open(spark, index.folder, Q.LAYERS)
    start = other.version()
    index.append(p.where("id >= 300"))
    monkeypatch.setattr(other, "version", lambda: start)
    with pytest.raises(Exception, match="exist"):
        other.append(p.where("id >= 300"))
    monkeypatch.undo()
    assert pairs(index.nearest(q, 3)) == pairs(knn.slsh_knn(p, q, Q.LAYERS, 3))


def test_a_lookup_reads_the_folders_asked_for(spark, vectors):
    p, q = vectors
    index = NeighbourIndex.create(spark, tempfile.mkdtemp() + "/index", knn.TwoLayers(Q.AXIS, Q.SIGN, 6, 1, 2, 2, 0.9), parts=32)
    index.append(p)
    plan = index.candidates(q.limit(1))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "part" in plan.split("PartitionFilters:")[1][:80]


def test_stream_sees_appends(spark, vectors):
    p, q = vectors
    got = pairs(Q.QUERIES["streamed_knn"](spark, "/root/testdata/sf0.001"))
    v, w = Q.vectors(spark, "/root/testdata/sf0.001")
    want = knn.slsh_knn(v.select("id", "vec"), w, Q.LAYERS, 5).select("qid", "rank", "id", F.round("dist", 6).alias("dist"))
    assert got == pairs(want)


def test_exact_neighbours_of_odd_vectors_in_many_matrices(spark, monkeypatch):
    monkeypatch.setattr(knn, "POINTS", 30)
    monkeypatch.setattr(knn, "ASKED", 7)
    monkeypatch.setattr(knn, "MATRIX", 8)
    rng = np.random.default_rng(5)
    v: list = [[float(x) for x in r] for r in rng.integers(-2, 3, (90, 3))]  # many equal vectors and distances
    v[3], v[4], v[5], v[6], v[7] = None, [1.0, None, 2.0], [1.0, 2.0], [0.0, 0.0, 0.0], [float("nan"), 1.0, 1.0]
    p = spark.createDataFrame(list(enumerate(v)), "id long, vec array<double>")
    q = p.where("id % 5 < 2 or id = 7").selectExpr("id AS qid", "vec AS qvec")
    for metric in ("l1", "euclidean", "cosine"):
        d = p.crossJoin(q).where("id <> qid").select("qid", "id", knn.DISTANCES[metric](F.col("vec"), F.col("qvec")).alias("dist"))
        want = knn.top_k(d, 6).select("qid", "rank", "id", "dist")
        assert sorted(map(str, knn.exact_knn(p, q, 6, metric).collect())) == sorted(map(str, want.collect()))


def test_exact_neighbours_ship_no_pair(spark):
    p = spark.range(60).selectExpr("id", "array(cast(id AS double), 1.0D) AS vec")
    q = p.selectExpr("id AS qid", "vec AS qvec")
    # what is ranked in the end are the nearest of each matrix, not all pairs
    assert knn.nearest_in_groups(p, q, [], 2, "l1").count() == 120


def test_comparisons_are_counted_without_pairs(spark):
    rng = np.random.default_rng(6)
    v = [[float(x) for x in r] for r in rng.uniform(-0.3, 0.3, (80, Q.DIM))]
    p = spark.createDataFrame([*enumerate(v), (3, v[9]), (4, v[4])], "id long, vec array<double>")  # an id with two vectors, one twice
    q = p.where("id % 3 = 0").selectExpr("id AS qid", "vec AS qvec")
    want = knn.comparison_counts(knn.lsh_candidates(p, q, Q.AXIS, 6, 8, 7).where("qid <> id"))
    assert sorted(map(tuple, knn.lsh_comparisons(p, q, Q.AXIS, 6, 8, 7).collect())) == sorted(map(tuple, want.collect()))


def test_buckets_searched_by_themselves_find_what_pairs_do(spark, monkeypatch):
    monkeypatch.setattr(knn, "POINTS", 25)
    monkeypatch.setattr(knn, "ASKED", 6)
    rng = np.random.default_rng(7)
    p = spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(rng.uniform(-0.3, 0.3, (120, Q.DIM)))], "id long, vec array<double>")
    q = p.where("id % 4 = 0").selectExpr("id AS qid", "vec AS qvec")
    for found, pairs, metric in (
        (knn.lsh_knn(p, q, Q.SIGN, 6, 3, 4, "cosine", probes=1), knn.lsh_candidates(p, q, Q.SIGN, 6, 3, 7, 1), "cosine"),
        (knn.slsh_knn(p, q, Q.LAYERS, 4), knn.slsh_candidates(p, q, Q.LAYERS), "l1"),
    ):
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, knn.nearest_of(pairs, p, q, 4, metric).collect()))
