"""Every registered query against its SQL, by value."""

import math

import duckdb
import pytest
from conftest import TESTDATA

from newsflow.catalog.oracle import ORACLE
from newsflow.catalog.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{TESTDATA}/{table}.parquet'")
    return connection


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_with_an_oracle_is_registered():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLE) == {"novelty_lsh"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, TESTDATA)
    got = sorted_rows(frame.columns, [tuple(r) for r in frame.collect()])
    assert got
    if name in ORACLE:
        result = duck.sql(ORACLE[name])
        assert sorted(frame.columns) == sorted(result.columns)
        expected = sorted_rows(result.columns, result.fetchall())
        assert len(got) == len(expected)
        assert [(g, e) for g, e in zip(got, expected) if g != e][:3] == []
