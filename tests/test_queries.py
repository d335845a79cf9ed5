"""Every query of the core with SQL of its own, over the whole smallest tables, against DuckDB."""

import math
import os
from collections import Counter

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v.isoformat() if hasattr(v, "isoformat") else tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in os.listdir(DATA):
        c.execute(f"create view {t.split('.')[0]} as select * from read_parquet('{DATA}/{t}')")
    return c


def core():
    import importlib

    out = {}
    for m in ("core_problems", "text_queries", "relational_queries", "evidence_queries", "matching_queries", "strategy_queries", "pipeline"):
        m = importlib.import_module(f"parcelforge.plans.{m}")
        out |= {k: (f, m.ORACLES.get(k)) for k, f in m.QUERIES.items()}
    return out


@pytest.mark.parametrize("name", [k for k, (_, sql) in core().items() if sql])
def test_same_rows(spark, duck, name):
    query, sql = core()[name]
    got = query(spark, DATA)
    want = duck.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    at = [names.index(c) for c in got.columns]
    assert Counter(tuple(map(plain, r)) for r in got.collect()) == Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", [k for k, (_, sql) in core().items() if not sql])
def test_rows_without_sql(spark, name):
    rows = core()[name][0](spark, DATA).count()
    assert rows > 0 or name == "case_uprns"  # the smallest tables have no address point in a case's polygon


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
