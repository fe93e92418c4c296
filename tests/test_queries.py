"""Every registered query of the engine against DuckDB on the smallest tables, and the driver's contract."""

import datetime as dt
import math
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__
from quern.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, list | tuple):
        return "[" + ",".join(plain(x) for x in v) + "]"
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int | float | Decimal):
        return f"{float(v):.8g}"
    if isinstance(v, dt.datetime):
        return v.isoformat(" ")
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_entry_and_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_agrees_with_its_sql(spark, duck, name):
    frame = registry.queries()[name](spark, SF)
    sql = registry.oracle_sql().get(name)
    got = frame.collect()
    if sql is None:
        return
    other = duck.execute(sql)
    names = [c[0] for c in other.description]
    assert sorted(names) == sorted(frame.columns)
    order = [names.index(c) for c in frame.columns]
    want = sorted(tuple(plain(r[i]) for i in order) for r in other.fetchall())
    assert sorted(tuple(plain(v) for v in r) for r in got) == want
