"""Every query with SQL gives what DuckDB gives, on the smallest data."""

import glob
import math
import os

import duckdb
import pytest

from lodestar.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return tuple(map(value, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    cols = sorted(df.columns)
    rel = duck.sql(SQL[name])
    assert cols == sorted(rel.columns)
    got = sorted((tuple(map(value, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr)
    want = sorted((tuple(map(value, r)) for r in duck.sql(f"select {', '.join(f'{chr(34)}{c}{chr(34)}' for c in cols)} from ({SQL[name]})").fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    df = QUERIES[name](spark, small)
    assert df.columns and df.count() >= 0
