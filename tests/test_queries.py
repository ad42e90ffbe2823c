"""Every catalog query against its SQL, over the smallest tables."""

from collections import Counter

import duckdb
import pytest

from palimpsest.plans.queries import QUERIES, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", queries())
def test_query(spark, db, name):
    run, sql = QUERIES[name]
    df = run(spark, SF)
    order = sorted(df.columns)
    got = Counter(tuple(r[c] for c in order) for r in df.collect())
    if sql:
        want = db.sql(sql)
        at = [want.columns.index(c) for c in order]
        assert len(want.columns) == len(order)
        assert got == Counter(tuple(r[i] for i in at) for r in want.fetchall())
    else:
        assert got


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
