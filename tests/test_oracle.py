"""Every query with SQL gives the rows that DuckDB gives over the same tables."""

import glob
import numbers
import os

import pandas as pd
import pytest

from ledgerloom import queries as core

DATA = os.environ.get("TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(df):
    out = []
    columns = sorted(df.columns)
    for r in df[columns].itertuples(index=False):
        out.append(tuple("" if pd.isna(x) else repr(float(x)) if isinstance(x, numbers.Real) and not isinstance(x, bool) else str(x)[:19] if "Timestamp" in type(x).__name__ else str(x) for x in r))
    return columns, sorted(out)


def test_every_query_has_sql():
    assert set(core.queries()) == set(core.oracle_sql())


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_equal(spark, duck, name):
    assert plain(core.queries()[name](spark, DATA).toPandas()) == plain(duck.execute(core.oracle_sql()[name]).df())
