"""Every registered query with SQL equals DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tessera.plans import registry

ORACLE = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return c


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, sf, con, name):
    got = registry.queries()[name](spark, sf)
    want = con.sql(ORACLE[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    a = ordered(tuple(r[c] for c in columns) for r in got.collect())
    at = [want.columns.index(c) for c in columns]
    assert a == ordered(tuple(r[i] for i in at) for r in want.fetchall())


def test_rest_gives_rows(spark, sf):
    for name in set(registry.queries()) - set(ORACLE):
        assert registry.queries()[name](spark, sf).count() > 0


def test_entry(spark, sf):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
