"""Short series are looked at together, and give what they give alone."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quiescent.functions import kernels as K
from quiescent.operators import signal


def table(spark):
    rng = np.random.default_rng(3)
    rows = [(None if k == 3 else k, i + 1, float(x)) for k in range(40) for i, x in enumerate(rng.normal(0, 5, 1 + k % 7 + 30 * (k % 2)))]
    return spark.createDataFrame(rows, "k long, i long, v double"), rows


def test_filters_of_many_series(spark):
    df, rows = table(spark)
    alone = {}
    for k in {r[0] for r in rows}:
        x = np.array([r[2] for r in rows if r[0] == k])
        for b in (K.butterworth(4, 0.5, 20.0, "high"), K.butterworth(2, (5, 6), 20.0, "stop"), K.butterworth(4, 8, 20.0, "low")):
            x = K.zero_phase(b, x)
        alone |= {(k, i + 1): y for i, y in enumerate(x)}
    got = signal.clean_filters(df, ["k"], 20.0, (0.5, 4), (5, 6, 4), (8, 4)).collect()
    assert len(got) == len(rows) and all(abs(r.v - alone[r.k, r.i]) < 1e-12 for r in got)
    parts = signal.apply_chunks(df, ["k"], lambda x: x * (x.ndim - 1), 10, 3, many=True)
    assert sorted(map(tuple, parts.collect()), key=str) == sorted(rows, key=str)


def test_responses_are_made_once():
    sos = K.butterworth(4, 3.0, 20.0, "low")
    before = K._responses.cache_info().misses
    for n in (5, 50, 300):
        K.zero_phase(sos, np.arange(float(n)))
    assert K._responses.cache_info().misses - before <= len(sos)


def test_trials_of_one_length_are_one_matrix(spark):
    df, rows = table(spark)
    df = df.withColumn("trial", F.floor((F.col("i") - 1) / 8)).withColumn("t", (F.col("i") - 1) % 8)
    got = {(r.k, r.freq, r.t): (r.power_db, r.itc, r.n) for r in signal.time_frequency(df, ["k"], "trial", 20.0, [2.0, 5.0]).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        x = np.array([r[2] for r in rows if r[0] == k])
        for j in range(0, len(x), 8):
            c = K.morlet(x[j : j + 8], 20.0, np.array([2.0, 5.0]))
            for a, f in enumerate((2.0, 5.0)):
                for t in range(c.shape[1]):
                    want.setdefault((k, f, t), []).append(c[a, t])
    assert got.keys() == want.keys()
    for key, c in want.items():
        p, itc = 10 * np.log10(np.mean(np.abs(c) ** 2)), abs(np.mean(np.array(c) / np.abs(c)))
        assert np.allclose(got[key], (p, itc, len(c)))


def test_a_series_is_never_parted(monkeypatch):
    monkeypatch.setattr(signal, "SERIES_ROWS", 10)
    length = [3, 25, 1, 4, 9, 2]
    at = np.concatenate([np.arange(1, n + 1) for n in length])
    batches = [pa.RecordBatch.from_arrays([pa.array(at[i : i + 4]), pa.array(np.arange(i, min(i + 4, len(at))))], ["at_", "x"]) for i in range(0, len(at), 4)]
    got = list(signal.whole_series(iter(batches), "at_"))
    assert np.concatenate([t["x"].to_numpy() for t in got]).tolist() == list(range(len(at))) and len(got) > 1
    assert all(t["at_"][0].as_py() == 1 for t in got)
