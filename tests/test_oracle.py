"""Every named query against its SQL counterpart on the smallest test tables."""

import math
import os

import duckdb
import pytest

import casewise.plans.file_queries  # noqa: F401
from casewise.plans.oracle import ORACLE
from casewise.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    return None if isinstance(value, float) and math.isnan(value) else value


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    result = duck.sql(ORACLE[name])
    columns = sorted(frame.columns)
    assert columns == sorted(result.columns)
    at = [result.columns.index(c) for c in columns]
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    want = sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
    assert got == want
