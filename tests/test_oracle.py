"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from orbispan.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def rows_of(df: pd.DataFrame) -> list:
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
            return "null"
        return repr(float(v)) if isinstance(v, float) else str(v)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, con, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.execute(catalog.SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_gives_rows(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert df.columns and df.count() > 0
