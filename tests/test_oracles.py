"""Every core query against its SQL, on the smallest tables; queries without SQL must run."""

import datetime
import decimal
import importlib
import math
import os
import pkgutil

import duckdb
import pytest

import panelwright.plans

MODULES = [importlib.import_module(f"panelwright.plans.{m.name}") for m in pkgutil.iter_modules(panelwright.plans.__path__)]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def views(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, views, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in ORACLES:
        return
    got = views.execute(ORACLES[name])
    names = [x[0] for x in got.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=str) == rows
