"""Every query with SQL, on the smallest tables, against DuckDB."""

import os

import duckdb
import pytest

from amberline.plans.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not there")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    found = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    columns = sorted(names)
    theirs = sorted(str([r[names.index(c)] for c in columns]) for r in found.fetchall())
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == theirs
