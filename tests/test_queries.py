"""Every query of the registry runs on the smallest tables, and equals its SQL where it has one."""

import glob
import os

import duckdb
import pytest

import oracle
from tessella import registry

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, db, name):
    df = registry.queries()[name](spark, DIR)
    ours = oracle.rows(df.columns, df.collect())
    sql = registry.oracle_sql().get(name)
    if sql:
        r = db.execute(sql)
        names = [c[0] for c in r.description]
        assert sorted(df.columns) == sorted(names) and ours == oracle.rows(names, r.fetchall())


def test_entry_has_the_queries_without_the_optional_part(spark):
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns
