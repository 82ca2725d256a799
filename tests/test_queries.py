"""Every query with SQL gives DuckDB's rows on the small tables."""

import math
import os

import pytest

import __spark_entry__ as entry
from assetgraph.plans.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are absent")


def norm(v):
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


def compare(spark, query, sql):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df, rel = query(spark, DIR), con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    got = sorted(repr(tuple(norm(r[c]) for c in sorted(df.columns))) for r in df.collect())
    want = sorted(repr(tuple(norm(r[rel.columns.index(c)]) for c in sorted(rel.columns))) for r in rel.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
