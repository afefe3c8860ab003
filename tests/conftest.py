import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    connection = duckdb.connect()
    for name in os.listdir(sf):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    return connection


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    if isinstance(value, (list, tuple)):
        return str([plain(x) for x in value])
    return str(value)


def same_rows(frame, connection, sql):
    """Asserts that a frame and a SQL query agree as multisets of rows."""
    names = sorted(frame.columns)
    mine = sorted(tuple(plain(r[c]) for c in names) for r in frame.collect())
    found = connection.execute(sql)
    order = [c[0] for c in found.description]
    assert sorted(order) == names
    theirs = sorted(tuple(plain(r[order.index(c)]) for c in names) for r in found.fetchall())
    assert mine == theirs


@pytest.fixture(scope="session")
def agree():
    return same_rows
