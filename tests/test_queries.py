"""Every registered query against its SQL, at the smallest scale."""

import os

import duckdb
import pandas as pd
import pytest

from milepost.plans import catalog

TABLES = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def plain(value):
    if pd.api.types.is_scalar(value) and pd.isna(value):
        return "-"
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted(tuple(map(plain, row)) for row in df[names].itertuples(index=False))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for table in os.listdir(TABLES):
        con.sql(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{TABLES}/{table}'")
    return con


def test_each_query_has_its_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the shared tables")
@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, name):
    got, want = rows_of(QUERIES[name](spark, TABLES).toPandas()), rows_of(db.sql(SQL[name]).df())
    assert got == want
    assert want[1]
