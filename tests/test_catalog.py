"""Every query that has SQL gives the same rows as DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from corpusmill.plans import catalog

SQL = catalog.oracle_sql()


def plain(v):
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and not isinstance(v, (str, bytes)) and getattr(v, "ndim", 0):
        return str([plain(x) for x in v])
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool":
        return str(bool(v))
    try:
        f = float(v)
        return str(int(v)) if f.is_integer() else format(f, ".6g")
    except (TypeError, ValueError):
        return str(v)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(v) for v in r) for r in df[cols].itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, sf, name):
    assert rows(catalog.queries()[name](spark, sf).toPandas()) == rows(con.sql(SQL[name]).df())


def test_entry(spark):
    assert entry.entry(spark).columns == ["rank", "row_id", "source", "title", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
