"""Pairs of segments: cells of the window alone, tiles that grow with their number, places without joins of pairs."""

from __future__ import annotations

import numpy as np

from quiescent.functions import kernels as K
from quiescent.operators import similarity


def plain_dtw(x, y, window):
    w = max(window, abs(len(x) - len(y)))
    c = np.full((len(x) + 1, len(y) + 1), np.inf)
    c[0, 0] = 0
    for i in range(1, len(x) + 1):
        for j in range(max(1, i - w), min(len(y), i + w) + 1):
            c[i, j] = abs(x[i - 1] - y[j - 1]) + min(c[i - 1, j], c[i, j - 1], c[i - 1, j - 1])
    return c[-1, -1]


def padded(rows):
    n = np.array([len(r) for r in rows])
    m = np.zeros((len(rows), n.max()))
    for k, r in enumerate(rows):
        m[k, : len(r)] = r
    return m, n


def test_warping_looks_at_its_window_alone(monkeypatch):
    cells = []

    class Counting:
        def __getattr__(self, name):
            return getattr(np, name)

        def minimum(self, a, b, out=None):
            cells.append(np.size(a))
            return np.minimum(a, b, out=out)

    rng = np.random.default_rng(3)
    x, n = rng.standard_normal((20, 300)), np.full(20, 300)
    monkeypatch.setattr(K, "np", Counting())
    K.dtw_many(x, x[::-1].copy(), n, n, 3)
    assert 0 < sum(cells) <= 2 * 7 * 300 * 20  # two for each cell, of which a row has 7 and not 300


def test_warping_of_tiles_equals_plain_loops(monkeypatch):
    rng = np.random.default_rng(4)
    for lengths in ((9,), (1, 2, 12), tuple(range(1, 15))):
        (a, na), (b, nb) = (padded([rng.standard_normal(rng.choice(lengths)) for _ in range(k)]) for k in (11, 23))
        for window, together in ((0, 8192), (1, 7), (3, 50), (200, 8192)):
            monkeypatch.setattr(K, "WARPED", together)
            want = [[plain_dtw(x[:n], y[:m], window) for y, m in zip(b, nb, strict=True)] for x, n in zip(a, na, strict=True)]
            assert np.array_equal(K.tile_dtw(a, b, na, nb, window), want)


def test_correlations_of_tiles_in_parts():
    rng = np.random.default_rng(6)
    (a, na), (b, nb) = (padded([rng.standard_normal(rng.integers(1, 9)) - 2 * (k % 2) for k in range(n)]) for n in (150, 131))
    want = [[np.correlate(x[:n], y[:m], "full").max() for y, m in zip(b, nb, strict=True)] for x, n in zip(a, na, strict=True)]
    assert np.allclose(K.tile_xcorr(a, b, na, nb), want, atol=1e-12)
    norms = [[np.linalg.norm(x) * np.linalg.norm(y) for y in b] for x in a]
    assert np.allclose(K.tile_xcorr(a, b, na, nb, True), np.array(want) / norms, atol=1e-12)


def test_tiles_grow_with_their_number(spark, monkeypatch):
    """A tile is sent to each other one: with tiles of a fixed size that is the square of the segments."""
    df = spark.range(4000).selectExpr("1 label", "id burst_id", "array(cast(id as float), 1f) burst_data")
    tile = similarity.tile_size(df, ["label"], "burst_data")
    assert 300 < tile < 400  # 8 million pairs, 64 pairs of tiles wanted; 63 tiles of 64 would be sent 63 times each
    t = similarity.tiles(df, ["label"], "burst_id", "burst_data", tile)
    assert t.count() <= 14 and dict(t.dtypes)["data"] == "array<array<float>>"
    monkeypatch.setattr(similarity, "TILE_SAMPLES", 100)
    assert similarity.tile_size(df, ["label"], "burst_data") == 50
    assert similarity.tile_size(df.where("false"), ["label"], "burst_data") == similarity.TILE


def test_pairs_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BATCH", 10)
    rng = np.random.default_rng(7)
    rows = [(g, 7 * k % 31, rng.standard_normal(rng.integers(3, 8)).astype("f4").tolist()) for g in ("x", "y") for k in range(30)]
    df = spark.createDataFrame([*rows, (None, 1, [1.0]), (None, 2, [1.0])], "g string, burst_id int, burst_data array<float>")
    by = {(g, k): v for g, k, v in rows}
    for tile in (7, 100):
        got = similarity.pair_similarity(df, ["g"], "dtw", window=1, tile=tile).collect()
        assert len({(r.g, r.a, r.b) for r in got}) == len(got) == 2 * 435
        assert all(r.a < r.b and abs(r.sim - plain_dtw(by[r.g, r.a], by[r.g, r.b], 1)) < 1e-12 for r in got)


def test_places_are_made_without_joins_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(similarity, "broadcast_counted", lambda df, n: df)
    from quiescent.plans.queries import QUERIES

    got = QUERIES["pair_vector_order"](spark, "/root/testdata/sf0.001")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[: plan.index("FlatMapGroupsInArrow")]  # above are the pairs
    by = {}
    for r in got.collect():
        by.setdefault(r.label, []).append((r.b, r.a, r.pos))
    assert by and all([x[2] for x in sorted(p)] == list(range(1, len(p) + 1)) for p in by.values())
