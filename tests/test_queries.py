"""Every registered query of the library's own operators against its SQL, over the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

from palimpsest import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    cursor = duck.execute(registry.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr) == theirs


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL) - {"cite_follow"}))
def test_runs_without_sql(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["book", "total", "shown_count"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
