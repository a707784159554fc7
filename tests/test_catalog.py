"""Every registered query with SQL gives what DuckDB gives."""

import os

import duckdb
import pytest

from factloom import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(_value(v) for v in r) for r in frame.itertuples(index=False))


def _value(v):
    if hasattr(v, "tolist") and not hasattr(v, "isoformat"):
        v = v.tolist()
    if v is None or isinstance(v, float) and v != v or str(v) in ("NaT", "<NA>"):
        return "null"
    return str(int(v)) if isinstance(v, float) and v == int(v) else str(v).removesuffix(" 00:00:00")


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    want = duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
