"""Every table query beside its SQL on DuckDB, and the driver's entry point."""

from __future__ import annotations

import math
import os

import pytest

import __spark_entry__ as entry_point
from tracequarry.plans import library_queries, table_queries  # noqa: F401

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(x):
    return None if isinstance(x, float) and math.isnan(x) else x


@pytest.mark.parametrize("name", sorted(table_queries.SQL))
def test_same_rows(spark, duck, name):
    df = table_queries.QUERIES[name](spark, DATA)
    got = [tuple(map(plain, r)) for r in df.select(sorted(df.columns)).collect()]
    duck.execute(f"create or replace temp table o as {table_queries.SQL[name]}")
    columns = sorted(r[0] for r in duck.execute("describe o").fetchall())
    assert columns == sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = [tuple(map(plain, r)) for r in duck.execute(f"select {quoted} from o").fetchall()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_entry_point(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
