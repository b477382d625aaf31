"""Table functions from SQL against the operators."""

from __future__ import annotations

import random

import pytest

from quiescent.functions import tablefunctions
from quiescent.operators import ranges


@pytest.mark.parametrize("tol", [0, 1, 3])
def test_ranges_in_sql(spark, tol):
    rnd = random.Random(tol)
    rows = [(k, h, rnd.randrange(60)) for k in ("a", "b", None) for h in (1, 2) for _ in range(40)] + [("a", 1, None)]
    df = spark.createDataFrame(rows, "k string, h int, i long").repartition(5)
    df.createOrReplaceTempView("points_to_join")
    tablefunctions.register(spark)
    got = spark.sql(f"SELECT * FROM index_ranges(TABLE(points_to_join), 'k, h', 'i', {tol})")
    assert got.columns == ["k", "h", "start_idx", "end_idx", "n"]
    assert sorted(map(str, got.collect())) == sorted(map(str, ranges.index_ranges(df, ["k", "h"], "i", tol).select("k", "h", "start_idx", "end_idx", "n").collect()))
    one = spark.sql("SELECT * FROM index_ranges(TABLE(SELECT i FROM points_to_join WHERE i < 50), '', 'i', 100)").collect()
    assert len(one) == 1 and one[0].n == df.where("i < 50").count()
    assert spark.sql("SELECT * FROM index_ranges(TABLE(SELECT * FROM points_to_join WHERE false), 'k', 'i', 1)").count() == 0


def test_wrong_arguments(spark):
    tablefunctions.register(spark)
    spark.range(3).createOrReplaceTempView("three_rows")
    for args in ("'k', 'id', 1", "'', 'x', 1", "'', 'id', -1"):
        with pytest.raises(Exception, match="wanted"):
            spark.sql(f"SELECT * FROM index_ranges(TABLE(three_rows), {args})")
