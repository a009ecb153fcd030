"""Queries with SQL give the rows that DuckDB gives over the same tables."""

import glob
import os

import pytest

from ledgerloom.llm import oracle, queries

DATA = os.environ.get("TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_equal(spark, name):
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = c.execute(oracle.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    rows = sorted(tuple(map(str, r)) for r in want.fetchall())
    got = queries.queries()[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(map(str, r)) for r in got.select(columns).collect()) == rows
