"""The EDF sink: stretches by several tasks, nothing left of a failed write."""

from __future__ import annotations

import os
import tempfile
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiescent.sources import edf


def recording(spark, rows=95):
    s = [("r1", c, i + 1, float(k * 10 + i % 7)) for k, c in enumerate(("b", "a")) for i in range(rows - 20 * k)] + [("r2", "x", 1, 5.0), ("r2", "x", 61, None), ("r2", None, 4, 1.0), (None, "x", 1, 1.0)]
    return spark.createDataFrame(s, "rec_id string, channel string, i long, v double").repartition(4)


def test_a_recording_by_several_tasks(spark):
    folder = tempfile.mkdtemp() + "/out"
    about = spark.createDataFrame([("r1", "p1", datetime(2020, 1, 2, 3, 4, 5))], "rec_id string, patient string, start timestamp")
    df = recording(spark)
    rows = edf.record_ranges(df, 10, about, per_task=2)
    assert sorted((r.rec_id, r.first, r["count"]) for r in rows.collect()) == [("r1", k, min(2, 10 - k)) for k in range(0, 10, 2)] + [("r2", k, min(2, 7 - k)) for k in range(0, 7, 2)]
    edf.save_edf(df, folder, 10, about, per_task=2)
    assert sorted(os.listdir(folder)) == ["r1.edf", "r2.edf"]
    m = np.zeros((2, 95))
    m[0, :75], m[1] = 10 + np.arange(75) % 7, np.arange(95) % 7
    assert open(f"{folder}/r1.edf", "rb").read() == edf.encode(m, 10, ["a", "b"], patient="p1", record="r1", start=datetime(2020, 1, 2, 3, 4, 5))
    back = spark.read.format("edf").option("recordsPerTask", "3").load(folder)
    assert back.where("rec_id = 'r2'").count() == 70 and back.where("rec_id = 'r1'").count() == 200
    edf.save_edf(df.where("rec_id = 'r2'"), folder, 10, per_task=50)  # again, and the other stays
    assert sorted(os.listdir(folder)) == ["r1.edf", "r2.edf"]
    edf.save_edf(df.where("false"), folder, 10)
    assert sorted(os.listdir(folder)) == ["r1.edf", "r2.edf"]


def test_a_failed_write_leaves_nothing(spark):
    folder = tempfile.mkdtemp() + "/out"
    os.makedirs(folder)
    edf.register(spark)
    rows = edf.record_ranges(recording(spark), 10, per_task=2)
    broken = rows.withColumn("body", F.when((F.col("rec_id") == "r1") & (F.col("first") == 4), F.lit(b"x")).otherwise(F.col("body")))
    for bad, said in ((broken, "bytes for"), (rows.where("not (rec_id = 'r1' and first = 4)"), "missing or double")):
        with pytest.raises(Exception, match=said):
            bad.write.format("edf").option("srate", 10).mode("append").save(folder)
        assert os.listdir(folder) == []


def test_short_files_are_read_together(spark, monkeypatch):
    folder = tempfile.mkdtemp()
    rng = np.random.default_rng(7)
    for k in range(60):
        with open(f"{folder}/s{k}.edf", "wb") as f:
            f.write(edf.encode(rng.standard_normal((2, 20 + k)) * 30, 10, ["a", "b"]))
    with open(f"{folder}/long.edf", "wb") as f:
        f.write(edf.encode(rng.standard_normal((2, 100_000)) * 30, 10, ["a", "b"]))
    parts = edf.EdfReader({"path": folder, "recordspertask": "4000"}).partitions()
    stretches = [s for p in parts for s in p.stretches]
    assert len(parts) <= 4 and len(stretches) == len(set(stretches)) == 63 and max(n for _, _, n in stretches) == 4000
    edf.register(spark)
    back = spark.read.format("edf").option("recordsPerTask", "4000").load(folder)
    plain = edf.read_edf_binary(spark, folder)
    assert back.count() == plain.count() and back.exceptAll(plain).isEmpty()
