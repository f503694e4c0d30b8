"""Every core query runs and, where there is SQL, gives the same rows in DuckDB."""

import glob
import os

import duckdb
import pytest

from compare import rows_of
from stepweave.plans import queries as core

QUERIES = core.queries()


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, con, name):
    df = QUERIES[name](spark, data)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sql = core.oracle_sql().get(name)
    if sql:
        cur = con.execute(sql)
        names = [c[0] for c in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert got == rows_of(names, cur.fetchall())


def test_every_sql_has_a_query():
    assert set(core.oracle_sql()) <= set(QUERIES)
