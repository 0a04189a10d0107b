"""All core queries against DuckDB on the smallest tables, and the driver's contract."""

from __future__ import annotations

import math
import os
import sys

import duckdb
import pytest

import __spark_entry__
from codelake.plans import catalogue


@pytest.fixture(scope="module")
def db(data):
    own = duckdb.connect()
    for name in os.listdir(data):
        own.execute(f"create view {name.removesuffix('.parquet')} as select * from '{data}/{name}'")
    return own


def plain(value):
    return round(value, 6) if isinstance(value, float) and not math.isnan(value) else value


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    return sorted(str([plain(r[n]) for n in order]) for r in found)


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, data, db, name):
    df = catalogue.QUERIES[name](spark, data)
    found = [tuple(r) for r in df.collect()]
    if name in catalogue.ORACLE:
        answer = db.execute(catalogue.ORACLE[name])
        columns = [d[0] for d in answer.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows(df.columns, found) == rows(columns, answer.fetchall())


def test_entry(spark, data):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_llm_part(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("codelake.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "codelake.llm", None)
    assert set(__spark_entry__.queries()) == set(catalogue.QUERIES)
