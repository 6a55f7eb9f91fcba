"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidewright import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def same(a, b):
    if isinstance(a, float) and isinstance(b, (int, float)):
        return a == b or (math.isnan(a) and math.isnan(b)) or abs(a - b) < 1e-9
    return a == b or str(a) == str(b)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    rows = sorted([tuple(r[c] for c in columns) for r in got.collect()], key=str)
    result = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted([tuple(r[names.index(c)] for c in columns) for r in result.fetchall()], key=str)
    assert len(rows) == len(want)
    for a, b in zip(rows, want, strict=True):
        assert all(same(x, y) for x, y in zip(a, b, strict=True)), (a, b)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(entry.queries()) and set(queries.ORACLE_SQL) <= set(entry.oracle_sql())
