"""Event alignment and one-pass resampling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quiescent.operators import events, similarity, stats


def test_planted_lags_are_found(spark):
    rng = np.random.default_rng(3)
    t = np.arange(-40, 41)
    bump = lambda s: 5 * np.exp(-(((t - s) / 4.0) ** 2))
    lags = {(u, k): int(rng.integers(-6, 7)) for u in range(2) for k in range(25)}
    rows = [(u, k, int(x), float(v)) for (u, k), s in lags.items() for x, v in zip(t, bump(s) + rng.normal(0, 0.05, len(t)), strict=True)]
    df = spark.createDataFrame([*rows, (0, 0, 99, None)], "u int, trial int, t int, v double").repartition(3)
    got, rounds = events.align_events(df, ["u"], 14)
    found = {(r.u, r.trial): r.lag for r in got.collect()}
    assert set(found) == set(lags) and rounds < 20
    for u in range(2):  # all but a shift that a user's trials have in common
        off = {found[u, k] - lags[u, k] for k in range(25)}
        assert len(off) == 1


def test_poisson_bootstrap(spark):
    rng = np.random.default_rng(5)
    x = rng.gamma(2.0, 3.0, 3000)
    df = spark.createDataFrame([(i, "a", float(v)) for i, v in enumerate(x)] + [(-1, "a", None), (-2, "b", None)], "id int, k string, v double").repartition(4)
    b = stats.poisson_bootstrap(df, ["k"], "v", ["id"], 150).toPandas()
    assert len(b) == 150 and set(b.k) == {"a"}
    exact = np.array([rng.choice(x, len(x)).mean() for _ in range(2000)])
    assert abs(b["mean"].mean() - x.mean()) < 0.3 * exact.std() and abs(b["mean"].std() / exact.std() - 1) < 0.2
    assert abs(b.n.mean() / 3000 - 1) < 0.01
    again = stats.poisson_bootstrap(df.repartition(7), ["k"], "v", ["id"], 150).toPandas()
    assert np.allclose(b.sort_values("replicate")["mean"], again.sort_values("replicate")["mean"])
    assert "Join" not in stats.poisson_bootstrap(df, ["k"], "v", ["id"], 3)._jdf.queryExecution().optimizedPlan().toString()


def test_pair_places(spark):
    s = spark.createDataFrame([(g, i * 7 % 31) for g in "xy" for i in range(9)], "g string, burst_id long")
    p = s.alias("p").join(s.alias("q"), "g").where("p.burst_id < q.burst_id").select("g", F.col("p.burst_id").alias("a"), F.col("q.burst_id").alias("b"))
    got = similarity.vector_order(p, ["g"], s).collect()
    for g in "xy":
        own = sorted((r.b, r.a, r.pos) for r in got if r.g == g)
        assert [x[2] for x in own] == list(range(1, 37))
