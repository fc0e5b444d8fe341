"""Every registered query against its SQL, at the smallest scale."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry_module

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
QUERIES = entry_module.queries()
SQL = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    yield connection
    connection.close()


@pytest.fixture(scope="module", autouse=True)
def no_codegen_fallback(spark):
    """A plan whose generated code is too large for the JVM fails instead of being interpreted."""
    spark.conf.set("spark.sql.codegen.fallback", "false")
    yield
    spark.conf.set("spark.sql.codegen.fallback", "true")


def comparable(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return None if value is None else f"{type(value).__name__}:{value}"


def in_order(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = in_order(tuple(comparable(row[c]) for c in columns) for row in df.collect())
    if name not in SQL:
        assert found
        return
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = in_order(tuple(comparable(row[names.index(c)]) for c in columns) for row in result.fetchall())
    assert found == expected


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() == 8
