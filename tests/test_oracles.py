"""Every query that has SQL equals it on the smallest tables."""

import math

import duckdb
import pytest

from quire.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def same_rows(frame, relation):
    names = sorted(frame.columns)
    assert names == sorted(relation.columns)
    mine = sorted(tuple(plain(r[n]) for n in names) for r in frame.collect())
    order = [relation.columns.index(n) for n in names]
    theirs = sorted(tuple(plain(r[i]) for i in order) for r in relation.fetchall())
    assert mine == theirs


@pytest.fixture(scope="session")
def duck():
    return connect()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    same_rows(registry.QUERIES[name](spark, SF), duck.sql(registry.ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
