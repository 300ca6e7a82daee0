"""Every registered query with a SQL counterpart gives the same rows in DuckDB."""

import duckdb
import pytest

import __spark_entry__ as contract
from tagloom.catalog import QUERIES
from tagloom.oracle import ORACLE_SQL

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def con(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    yield connection
    connection.close()


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    # An iterative fit; tests/test_linear.py compares it with pyspark.ml.
    assert set(QUERIES) - set(ORACLE_SQL) == {"ovr_logreg_predict"}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted(repr(tuple(row[c] for c in columns)) for row in df.collect())
    result = con.sql(ORACLE_SQL[name])
    places = [result.columns.index(c) for c in columns]
    assert len(result.columns) == len(columns)
    theirs = sorted(repr(tuple(row[i] for i in places)) for row in result.fetchall())
    assert ours == theirs


def test_entry(spark):
    assert contract.entry(spark).columns == ["appId", "predictedLabelFinal"]
