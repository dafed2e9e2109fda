"""Registered queries against their SQL in DuckDB."""

import os

import duckdb
import pytest

from marlgate.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, data, name):
    con = duckdb.connect()
    for file in os.listdir(data):
        con.execute(f"create view {file.split('.')[0]} as select * from '{data}/{file}'")
    df = queries.queries()[name](spark, data)
    columns = sorted(df.columns)
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == sorted(repr([r[names.index(c)] for c in columns]) for r in found.fetchall())
