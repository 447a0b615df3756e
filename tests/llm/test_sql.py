"""Queries that SQL can express, against DuckDB on the small tables and on the fixture."""

import os

import duckdb
import pytest

from corpusloom.llm import registry

SF = "/root/testdata/sf0.001"


def same(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        path = f"{sf}/{f}"
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    cur = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()), key=repr)
    assert sorted(names) == cols and sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == want and want


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", registry.ORACLE_SQL)
def test_small_tables(spark, name):
    same(spark, SF, name)


@pytest.mark.parametrize("name", registry.ORACLE_SQL)
def test_fixture(spark, sf_dir, name):
    same(spark, sf_dir, name)
