"""Queries against their SQL."""

import os

import duckdb
import pytest

from docloom.llm import queries

SF = "/root/testdata/sf0.01"
QUERIES, ORACLES = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    duck = duckdb.connect()
    for f in os.listdir(SF):
        duck.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    out, expected = QUERIES[name](spark, SF), duck.sql(ORACLES[name])
    assert sorted(expected.columns) == sorted(out.columns)
    at = [expected.columns.index(c) for c in out.columns]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in expected.fetchall()), key=repr)
