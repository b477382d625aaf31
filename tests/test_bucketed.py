"""Bucketed recordings: three operators whose plans have no exchange."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from quiescent.operators import montage
from quiescent.sources import bucketed


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_exchange(spark):
    folder = tempfile.mkdtemp()
    s = spark.range(2 * 3 * 400).selectExpr("concat('r', id % 2) as rec_id", "element_at(array('Fp1', 'F7', 'T3'), cast(floor(id / 2) % 3 + 1 as int)) as channel", "cast(floor(id / 6) as long) + 1 as i", "cast(hash(id) % 100 as double) as v")
    r = spark.createDataFrame([("r0", 5, 130, "x"), ("r0", 399, 420, "y"), ("r1", 100, 101, "z"), ("r9", 1, 2, "w")], "rec_id string, start_idx long, end_idx long, name string")
    t = bucketed.save_bucketed(bucketed.with_block(s, size=64), "rec_samples", f"{folder}/s", ["rec_id"], 4, ["i", "channel"])
    bucketed.save_bucketed(bucketed.blocks_of_ranges(r, size=64), "rec_ranges", f"{folder}/r", ["rec_id"], 4)
    try:
        keys = ["rec_id", "block", "i"]
        referenced = montage.average_reference(t, keys)
        pairs = montage.bipolar(t, keys, [("Fp1", "F7"), ("F7", "T3")])
        inside = bucketed.in_ranges(spark, "rec_samples", "rec_ranges", ["rec_id"])
        assert [plan(x).count("Exchange") for x in (referenced, pairs, inside)] == [0, 0, 0]
        plain = montage.average_reference(s, ["rec_id", "i"])
        cols = ["rec_id", "channel", "i"]
        assert referenced.select(*cols, F.round("v", 9)).exceptAll(plain.select(*cols, F.round("v", 9))).count() == 0 and referenced.count() == s.count()
        want = s.join(r, "rec_id").where("i between start_idx and end_idx")
        assert sorted(inside.select(*cols, "name").collect()) == sorted(want.select(*cols, "name").collect())
        assert spark.table("rec_samples").groupBy("rec_id").agg(F.count_distinct("block").alias("n")).agg(F.min("n")).first()[0] == 7
    finally:
        spark.sql("DROP TABLE rec_samples")
        spark.sql("DROP TABLE rec_ranges")
