"""Every query with SQL against DuckDB at the smallest scale; the others for rows."""

import math
from collections import Counter

import duckdb
import pytest

from glyphflow.plans import catalogue, composed, pages

SF = "/root/testdata/sf0.001"
TABLES = "lineitem orders events embeddings documents conversations nation".split()
QUERIES, SQL = {**catalogue.QUERIES, **pages.QUERIES, **composed.QUERIES}, {**catalogue.SQL, **pages.SQL, **composed.SQL}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return "0.0" if isinstance(v, float) and v == 0 else str(v)


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    if name not in SQL:
        assert df.count() > 0
        return
    got = duck.execute(SQL[name])
    cols = [c[0] for c in got.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(cols, got.fetchall())
