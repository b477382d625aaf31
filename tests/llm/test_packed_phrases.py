"""Counts of phrases sent packed: nothing lost, and far fewer bytes than a row a phrase."""

from __future__ import annotations

import numpy as np

from quiescent.llm import collocations as C


def test_packed_counts_are_whole_and_small(spark, monkeypatch):
    rng = np.random.default_rng(3)
    k = np.unique(rng.integers(0, 1 << 19, 50_000) << 32 | rng.integers(0, 1 << 12, 50_000))
    w, n = rng.integers(-1, 1 << 31, len(k)).astype(np.int32), rng.geometric(0.5, len(k))
    n[0] = 1 << 40
    got = C.unpacked(C.packed(k, w, n), len(k))
    assert all(np.array_equal(x, y) for x, y in zip(got, (k, w, n), strict=True))
    # a row of 8, 4 and 8 bytes would have 20
    assert len(C.packed(k, np.full(len(k), -1), n)) < 6 * len(k)
    # many parts, and several sendings a task
    monkeypatch.setattr(C, "HELD", 50)
    seqs = [rng.integers(0, 9, 400).astype(np.int32) for _ in range(6)]
    df = spark.createDataFrame([(x.tolist(),) for x in seqs], "seq array<int>").coalesce(2)
    for m in (2, 3):
        want: dict = {}
        for x in seqs:
            for i in range(len(x) - m + 1):
                p = tuple(x[i : i + m] - 1)
                if min(p) >= 0:
                    want[p] = want.get(p, 0) + 1
        rows = C.count_phrases(df, m, 7, 5).collect()
        assert {(r.k >> 32, r.k & 0xFFFFFFFF, *([r.w] if m == 3 else [])): r.a for r in rows} == {p: c for p, c in want.items() if c >= 5}
        assert len(rows) == len({(r.k, r.w) for r in rows})
