"""Every query that SQL can express returns the rows of its SQL, on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from quiescent.plans.oracles import ORACLES
from quiescent.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x: object) -> object:
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return float(f"{x:.7g}") + 0.0
    return x


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    want = con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    got, exp = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(want.columns, want.fetchall())
    assert len(got) == len(exp)
    for a, b in zip(got, exp, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) <= 2e-6 * max(1, abs(x))), (a, b)


def test_registry_is_whole():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries())
    assert set(ORACLES) <= set(e.oracle_sql())
