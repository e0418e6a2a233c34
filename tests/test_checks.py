"""Every registered query against the checking engine, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from jobmart.checks import all_queries, all_sql

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages"
          " benchmark labels conversations").split()
QUERIES, SQL = all_queries(), all_sql()


@pytest.fixture(scope="module")
def engine(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, engine, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    cursor = engine.execute(SQL[name])
    order = [d[0] for d in cursor.description]
    assert sorted(order) == columns
    want = [tuple(plain(r[order.index(c)]) for c in columns) for r in cursor.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
