"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from pulseframe.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{SF}/{f}')")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda v: None if v is None else str(v))
    return df.sort_values(list(df.columns), na_position="first", kind="stable").reset_index(drop=True)


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    assert len(a) == len(b)
    a, b = plain(a), plain(b)
    for c in a.columns:
        if a[c].dtype != object and b[c].dtype != object:
            np.testing.assert_array_equal(a[c].astype(float), b[c].astype(float), err_msg=c)
        else:
            assert a[c].astype(str).tolist() == b[c].astype(str).tolist(), c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    same(QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert len(QUERIES[name](spark, SF).columns) > 0
