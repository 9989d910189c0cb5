from __future__ import annotations

import datetime

import pytest
from pyspark.sql import SparkSession

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("colonnade-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def main(spark):
    """Mixed types, nulls, an all-null column and a quote in a text."""
    day = datetime.date
    rows = [
        (1, 10.5, "alpha", None, True, day(2024, 1, 1)),
        (2, 20.0, "beta", None, False, day(2024, 1, 2)),
        (3, None, "O'Brien", None, None, day(2024, 1, 3)),
        (4, 5.0, "delta", None, True, day(2024, 1, 4)),
        (5, 30.0, "gamma", None, False, day(2024, 1, 5)),
    ]
    return spark.createDataFrame(
        rows, "id int, val double, txt string, empty_col string, flag boolean, d date"
    )


@pytest.fixture(scope="session")
def products(spark):
    rows = [(1, 100.0, "apple"), (2, 200.0, "banana"), (3, 150.0, "cherry"), (4, 250.0, "date")]
    return spark.createDataFrame(rows, "id int, price double, product string")


def values(df, column=None):
    """The cells of a column (the first by default), in the order they come."""
    return [row[column if column is not None else 0] for row in df.collect()]
