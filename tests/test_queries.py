"""Every registered query of the library against its SQL on the smallest tables."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from attestor.plans import evaluation_queries, registry, retrieval_queries, study_queries  # noqa: F401

from .conftest import SMALL


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for file in os.listdir(SMALL):
        connection.execute(f"create view {file.removesuffix('.parquet')} as select * from '{SMALL}/{file}'")
    return connection


def plain(value):
    if isinstance(value, Decimal):
        return float(value)
    return None if isinstance(value, float) and math.isnan(value) else value


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, tables, name):
    found = registry.QUERIES[name](spark, SMALL)
    rows = [r.asDict() for r in found.collect()]
    assert rows
    if name not in registry.ORACLES:
        return
    cursor = tables.execute(registry.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(found.columns)
    expected = [dict(zip(columns, r, strict=True)) for r in cursor.fetchall()]
    order = sorted(columns)
    assert sorted(repr([plain(r[c]) for c in order]) for r in rows) == sorted(repr([plain(r[c]) for c in order]) for r in expected)


def test_every_query_is_listed_by_the_entry_module():
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
