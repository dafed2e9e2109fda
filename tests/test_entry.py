"""Every registered query against its SQL twin in DuckDB, on the smallest data."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from marlgate.plans import oracles, queries


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in os.listdir(data):
        con.execute(f"create view {name.split('.')[0]} as select * from '{data}/{name}'")
    return con


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted(repr([r[c] for c in columns]) for r in df.collect())


def duck_rows(con, sql):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted(repr([r[i] for i in order]) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_sql(spark, data, duck, name):
    assert rows_of(queries.queries()[name](spark, data)) == duck_rows(duck, oracles.oracle_sql()[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_but_the_trained_one_has_sql():
    assert set(queries.queries()) - set(oracles.oracle_sql()) == {"classifier_accuracy"}


def test_classifier(spark, data):
    assert queries.classifier_accuracy(spark, data).first()["accuracy"] > 0.95
