"""Every query runs; those with SQL give DuckDB's rows on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from quern.queries import ALL

DATA = "/root/testdata/sf0.001"


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    v = v.item() if hasattr(v, "item") else v
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


def content(df):
    df = df[sorted(df.columns)].astype(object)
    return list(df.columns), sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(ALL))
def test_query(spark, duck, name):
    query, sql = ALL[name]
    found = query(spark, DATA).toPandas()
    if sql is not None:
        assert content(found) == content(duck.sql(sql).df())


def test_pushdown(spark):
    plan = ALL["p06_keep_others"][0](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "c_mktsegment" in plan and "c_acctbal" not in plan
