"""Every query at the smallest scale: against its SQL twin where it has one, else that it runs and has a stable schema."""

import datetime
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CORE = [n for m in entry.MODULES if not m.__name__.startswith("lodeworks.llm") for n in m.QUERIES]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if v != v else float(f"{v:.10g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    return v


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    rows = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    assert sorted(rows, key=repr) == sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["contract_award_unique_key", "version_id"] and df.count() > 0


def test_names_of_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
