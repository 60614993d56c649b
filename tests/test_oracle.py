"""Every query with SQL against DuckDB, over the small tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tessera.plans import QUERIES, SQL


def rows(df):
    df = df[sorted(df.columns)]

    def plain(v):
        if v is None or v is pd.NA or v != v:
            return None
        if isinstance(v, float):
            return round(v, 5)
        return int(v) if hasattr(v, "__int__") and not isinstance(v, str) else str(v)

    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got) and len(set(got.columns)) == len(got.columns)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["path", "title", "title_match", "score", "snippet"] and 0 < df.count() <= 20


def test_sql_only_for_registered_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
