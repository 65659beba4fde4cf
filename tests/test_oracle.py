"""Every query with SQL against DuckDB on the same tables."""

import os

import duckdb
import pytest

from terravane.queries import QUERIES, SQL

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def _norm(rows):
    return sorted((tuple(float(f"{x:.9g}") if isinstance(x, float) else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA), duck.sql(SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    a = _norm(tuple(r[c] for c in columns) for r in got.collect())
    order = [want.columns.index(c) for c in columns]
    b = _norm(tuple(r[i] for i in order) for r in want.fetchall())
    assert a == b
