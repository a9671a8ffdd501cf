"""One Spark session for all tests, and a comparison of queries with their SQL."""

from __future__ import annotations

import os
import sys

import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plain(value):
    """A value in a form that is alike for Spark and DuckDB."""
    if hasattr(value, "tolist"):
        value = value.tolist()
    if value is None or value is pd.NA or isinstance(value, float) and value != value:
        return None
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f"{value:.12g}"
    if isinstance(value, list):
        return tuple(map(plain, value))
    return str(value)


def rows_of(frame) -> list[tuple]:
    """A pandas frame's rows as sorted plain tuples, columns by name."""
    columns = sorted(frame.columns)
    return sorted((tuple(map(plain, row)) for row in frame[columns].itertuples(index=False)), key=repr)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{file}'")
    return con
