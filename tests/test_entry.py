"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from plumbline import catalogue

FOLDER = entry_module.FLAGSHIP_DIR
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
# The training-data queries have their own tests.
QUERIES = {name: query for name, query in entry_module.queries().items() if name in catalogue.QUERIES}
ORACLES = {name: sql for name, sql in entry_module.oracle_sql().items() if name in catalogue.QUERIES}


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(repr([row[i] for i in order]) for row in rows)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES) == set(catalogue.QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, oracle, name):
    frame = QUERIES[name](spark, FOLDER)
    answer = oracle.execute(ORACLES[name])
    names = [column[0] for column in answer.description]
    expected = canonical(names, answer.fetchall())
    assert canonical(frame.columns, frame.collect()) == expected
    assert expected[1], "a comparison of nothing proves nothing"


def test_flagship(spark):
    assert entry_module.entry(spark).count() > 0
