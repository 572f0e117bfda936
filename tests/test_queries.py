"""Every registered query against its DuckDB SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from suite import all_queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = all_queries.QUERIES, all_queries.ORACLE

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in sorted(os.listdir(SF_DIR)):
        name, ending = os.path.splitext(file)
        if ending == ".parquet":
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{file}'")
    return connection


def test_every_oracle_has_its_query():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(ORACLE) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SF_DIR)
    columns = sorted(frame.columns)
    got = sorted(repr(tuple(row[c] for c in columns)) for row in frame.collect())
    if name not in ORACLE:
        assert got
        return
    result = duck.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    expected = sorted(repr(tuple(row[i] for i in places)) for row in result.fetchall())
    assert got == expected


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["day", "n"]
