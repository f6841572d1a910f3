"""Every query against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tempora import plans

SF = "/root/testdata/sf0.001"
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(x):
    if x is None or x is pd.NA or x != x:
        return None
    x = x.item() if hasattr(x, "item") else x
    return round(float(x), 7) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


def rows(df):
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    want = duck.sql(plans.SQL[name])
    assert {c: KINDS[k] for c, k in df.dtypes} == dict(zip(want.columns, map(str, want.types), strict=True))
    assert rows(df.toPandas()) == rows(want.df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
