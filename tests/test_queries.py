"""Every registered query with SQL against DuckDB, on the smallest tables where they are there."""

import os

import duckdb
import pytest

import __spark_entry__

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def canonical(df):
    columns = sorted(df.columns)
    df = df.convert_dtypes()  # whole numbers with nulls are floats in one of the two
    return sorted(map(str, df[columns].astype(str).itertuples(index=False, name=None))), columns


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query(spark, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    assert canonical(__spark_entry__.queries()[name](spark, FOLDER).toPandas()) == canonical(db.execute(__spark_entry__.oracle_sql()[name]).df())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
