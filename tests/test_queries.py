"""Queries against their SQL in DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from loomtext.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents benchmark labels pages conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == cols
    want = [[row[names.index(c)] for c in cols] for row in cursor.fetchall()]
    rows = [[r[c] for c in cols] for r in got.collect()]
    assert sorted(repr(plain(r)) for r in rows) == sorted(repr(plain(r)) for r in want)


def test_every_query_without_sql_runs(spark):
    for name in sorted(set(QUERIES) - set(ORACLES)):
        assert QUERIES[name](spark, SF).count() > 0, name
