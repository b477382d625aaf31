"""Nearest places among many: found in small cells first."""

from __future__ import annotations

import numpy as np

from quiescent.operators import sourcespace


def test_nearest_voxels_meet_few(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.uniform(0, 10, (1500, 3)), [[14.0, 5, 5], [14.0, 5, 5]]])
    g = np.concatenate([rng.uniform(0, 10, (400, 3)), [[19.0, 5, 5], [34.0, 5, 5], [35.0, 5, 5], [19.0, 5, 5]]])
    voxels = spark.createDataFrame([(5000 - i, *map(float, x)) for i, x in enumerate(v)], "voxel long, x double, y double, z double")
    grid = spark.createDataFrame([*((i, *map(float, x)) for i, x in enumerate(g)), (900, None, 0.0, 0.0)], "point long, x double, y double, z double")
    seen = []
    real = sourcespace._around

    def watched(places, targets, cell, tasks):
        seen.append((cell, places.count()))
        return real(places, targets, cell, tasks)

    monkeypatch.setattr(sourcespace, "_around", watched)
    got = {r.point: (r.voxel, r.dist) for r in sourcespace.nearest_voxels(grid, voxels, 20.0).collect()}
    want = {}
    for i, x in enumerate(g):
        d = np.sqrt(((v - x) ** 2).sum(axis=1))
        k = min(range(len(v)), key=lambda j: (d[j], 5000 - j))
        if d[k] <= 20:
            want[i] = (5000 - k, d[k])
    assert got.keys() == want.keys() and all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-12 for i in want)
    assert 401 in got and 402 not in got
    # a cell of the first round has few voxels, and the widest cells are looked at for what lies apart only
    assert seen[0][0] < 3 and seen[-1] == (20.0, 2)
    far = sourcespace.nearest_points(grid, voxels.withColumnRenamed("voxel", "target"), 1.0)
    assert {r.point for r in far.collect()} == set(range(len(g)))


def test_no_voxels(spark):
    grid = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "point int, x double, y double, z double")
    none = spark.createDataFrame([], "voxel int, x double, y double, z double")
    assert sourcespace.nearest_voxels(grid, none, 2.0).count() == 0
