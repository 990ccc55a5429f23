"""The queries against their SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from rankweave.plans.registry import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return str(v.normalize()) if hasattr(v, "normalize") else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, DIR)
    names = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in names]) for r in df.collect())
    cur = con.execute(ORACLE_SQL[name])
    theirs = [d[0] for d in cur.description]
    assert sorted(theirs) == names
    at = [theirs.index(c) for c in names]
    assert got == sorted(str([plain(r[i]) for i in at]) for r in cur.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(QUERIES) <= set(__spark_entry__.queries())
