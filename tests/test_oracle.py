"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import math
import os
from decimal import Decimal

import pytest

import __spark_entry__ as entry_points
from conftest import plan
from mailloom.plans.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages"
          " benchmark labels conversations").split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, (float, Decimal)):
        return None if math.isnan(value) else repr(float(value))
    return None if value is None else str(value)


def table(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


# Queries without SQL belong to the training-data operators, whose own tests hold them against brute force.
NAMED = sorted({*QUERIES, *entry_points.oracle_sql()})


@pytest.mark.parametrize("name", NAMED)
def test_query(spark, duck, name):
    df = entry_points.queries()[name](spark, SF)
    text = plan(df)
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    got = table(df.collect(), df.columns)
    cursor = duck.execute(entry_points.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert got == table(cursor.fetchall(), names)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
