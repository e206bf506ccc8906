"""Every query with SQL beside it gives what DuckDB gives on the smallest tables."""

import decimal
import math
import os

import duckdb
import pandas as pd
import pytest

from spanview import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (bool, str)):
        return v
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(plain(x) for x in v)
    return float(f"{v:.10g}") if isinstance(v, (int, float)) else v


def table(columns, rows):
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    return order, sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@needs_data
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_meets_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    want = duck.sql(registry.oracle_sql()[name])
    got = table(df.columns, [tuple(r) for r in df.collect()])
    assert got == table([d[0] for d in want.description], want.fetchall())


@needs_data
@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_other_queries_run(spark, name):
    assert isinstance(registry.queries()[name](spark, DATA).limit(3).toPandas(), pd.DataFrame)


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
