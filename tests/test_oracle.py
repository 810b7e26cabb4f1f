"""Every query with a SQL twin against DuckDB on the smallest tables."""

import math

import numpy as np
import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL

SQL = {k: v for k, v in entry.oracle_sql().items()}


def canonical(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "null"
        if isinstance(x, (bool, np.bool_)):
            return str(bool(x))
        if isinstance(x, (int, float, np.integer, np.floating)):
            return repr(float(x) + 0.0)
        return str(x)

    return sorted(tuple(one(r[i]) for i in order) for r in records)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_duckdb(spark, duck, name):
    got = entry.queries()[name](spark, SMALL)
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical([tuple(r) for r in got.collect()], got.columns) == canonical(want.fetchall(), want.columns)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() >= 0
