"""Every query with SQL gives DuckDB's result on the same tables."""

import duckdb
import pytest

import __spark_entry__
from strataflow import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def key(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, duck, data, name):
    df = queries.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    ours = sorted((tuple(r) for r in df.select(*columns).collect()), key=key)
    listed = ", ".join(f'"{c}"' for c in columns)
    theirs = sorted(map(tuple, duck.sql(f"SELECT {listed} FROM ({queries.ORACLES[name]})").fetchall()), key=key)
    assert ours == theirs
    assert sorted(duck.sql(queries.ORACLES[name]).columns) == columns


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and all(r.abs_err <= r.bound for r in rows)


def test_registry():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
