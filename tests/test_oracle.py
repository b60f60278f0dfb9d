"""Every query with SQL equals DuckDB on the smallest tables, in values and names."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    found = con.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    df = QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    want = sorted(repr([r[columns.index(c)] for c in order]) for r in found.fetchall())
    assert sorted(repr([r[c] for c in order]) for r in df.collect()) == want
