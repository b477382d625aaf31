"""Components, sphering and k-means against numpy; streams of late samples."""

from __future__ import annotations

import random
import tempfile
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiescent.operators import decompose
from quiescent.operators.recursive import ema_variance_kernel
from quiescent.streaming import ordered

BAD = [(900, None), (901, [1.0]), (902, [float("nan"), 0.0, 0.0, 0.0]), (903, [float("inf"), 0.0, 0.0, 0.0]), (904, [None, 1.0, 2.0, 3.0])]


def frame(spark, x):
    return spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)] + BAD, "id int, vec array<double>").repartition(5).withColumn("cell", F.lit("clash"))


def test_components_and_sphering(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 4)) @ rng.standard_normal((4, 4)) + 1e6
    df = frame(spark, x)
    m = decompose.moments(df)
    assert m.n == 400 and np.allclose(m.mean, x.mean(0)) and np.allclose(m.cov, np.cov(x.T), rtol=1e-8)
    c = decompose.principal_components(df, 2)
    want = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert np.allclose(c.variances, want[:2]) and np.allclose(c.shares, want[:2] / want.sum())
    got = {r.id: r.vec for r in decompose.projected(df, c.axes, c.mean).collect()}
    y = np.array([got[i] for i in range(400)])
    assert len(got) == 405 and all(got[i] is None for i, _ in BAD) and np.allclose(np.cov(y.T), np.diag(want[:2]), atol=1e-6)
    s = decompose.sphering(df)
    assert np.allclose(s @ np.cov(x.T) @ s.T, 4 * np.eye(4), atol=1e-6)
    flat = frame(spark, np.c_[x[:, :3], x[:, 0]])
    assert np.isfinite(decompose.sphering(flat)).all()
    with pytest.raises(ValueError, match="no vectors"):
        decompose.moments(df.where("false"))


def plain_kmeans(x, k, rounds=100):
    c = x[:k].copy()
    for r in range(1, rounds + 1):
        at = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        new = np.array([x[at == j].mean(0) if (at == j).any() else c[j] for j in range(k)])
        if np.allclose(new, c, atol=0, rtol=0) or np.abs(new - c).max() <= 1e-12:
            return at, c, r
        c = new
    return at, c, rounds


def test_kmeans(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(m, 0.4, (70, 4)) for m in (-3, 0, 4)] + [np.ones((30, 4))])
    x = x[rng.permutation(len(x))]
    df = frame(spark, x)
    got = decompose.kmeans(df, 3, tol=1e-12)
    at, c, rounds = plain_kmeans(x, 3)
    assert np.allclose(got.centres, c) and got.rounds == rounds and got.sizes.tolist() == np.bincount(at, minlength=3).tolist()
    rows = {r.id: (r.cluster, r.d2) for r in decompose.clustered(df, got).collect()}
    assert [rows[i][0] for i in range(len(x))] == at.tolist() and abs(sum(rows[i][1] for i in range(len(x))) - got.error) < 1e-6
    assert all(rows[i] == (None, None) for i, _ in BAD)
    few = decompose.kmeans(df.where("id < 2"), 5)
    assert len(few.centres) == 2 and few.error == 0.0


def test_late_samples_take_their_place(spark):
    ordered.needs_state_store(spark)
    rnd = random.Random(6)
    start = datetime(2024, 1, 1)
    rows = [(u, start + timedelta(seconds=20 * i + u), i, rnd.gauss(0, 5)) for u in range(3) for i in range(60)]
    rows += [(1, start + timedelta(seconds=20 * 30 + 1), 30, 7.0), (1, start + timedelta(seconds=20 * 30 + 1), 5, 8.0)]  # one time twice, once with one tie
    late = 300
    arrives = sorted(rows, key=lambda r: (r[1] + timedelta(seconds=rnd.randrange(late)), r[2]))
    schema = "u int, ts timestamp, k long, v double"
    queue, out, progress = (tempfile.mkdtemp() + "/x" for _ in range(3))
    dropped = 0
    parts = [arrives[i : i + 61] for i in range(0, len(arrives), 61)]
    for part in [*parts, None]:
        df = ordered.end_marker(spark.createDataFrame(rows[:1], schema), ["u"], "ts") if part is None else spark.createDataFrame(part, schema)
        df.write.mode("append").parquet(queue)
        s = ordered.ordered_ema_stream(spark.readStream.schema(schema).parquet(queue), ["u"], "ts", "k", "v", 0.9, 10.0, f"{late} seconds")
        q = s.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start()
        q.awaitTermination()
        dropped += sum(o.get("numRowsDroppedByWatermark", 0) for p in q.recentProgress for o in p["stateOperators"])
    got = spark.read.parquet(out).orderBy("u", "i").collect()
    assert dropped == 0 and len(got) == len(rows)
    for u in range(3):
        own = sorted((r for r in rows if r[0] == u), key=lambda r: (r[1], r[2]))
        mine = [r for r in got if r.u == u]
        assert [r.i for r in mine] == list(range(1, len(own) + 1)) and [r.k for r in mine] == [r[2] for r in own]
        if u != 1:  # its two copies of one place may come in either order
            mu, var = ema_variance_kernel(np.array([r[3] for r in own]), 0.9)
            assert np.allclose([r.mu for r in mine], mu) and np.allclose([r.var for r in mine], var)
    with pytest.raises(ValueError, match="bigint"):
        ordered.ordered_ema_stream(spark.readStream.schema("u int, ts timestamp, k int, v double").parquet(queue), ["u"], "ts", "k", "v", 0.9, 1.0, "1 hour")
