"""Every registered query of the stream operators equals its SQL on the driver's tables."""

from __future__ import annotations

import decimal

import duckdb
import pytest

import __spark_entry__ as entry_module
from millrace.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def plain(v):
    return float(v) if isinstance(v, decimal.Decimal) else round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_sql(spark, db, small, name):
    df = catalogue.queries()[name](spark, small)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted((tuple(plain(x[i]) for i in at) for x in result.fetchall()), key=repr)


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0 and "success_rate" in df.columns


def test_registry_is_consistent():
    names = entry_module.queries()
    assert set(entry_module.oracle_sql()) <= set(names)
    assert set(catalogue.queries()) <= set(names)
