import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


# tests build literals when they are collected, which takes a session
SESSION = (
    SparkSession.builder.master("local[4]")
    .config("spark.sql.shuffle.partitions", "4")
    .config("spark.driver.memory", "4g")
    .config("spark.ui.enabled", "false")
    .config("spark.sql.session.timeZone", "UTC")
    .getOrCreate()
)
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    return SESSION


def plain(value):
    """Rows as tuples, arrays as lists."""
    if isinstance(value, tuple):
        return tuple(plain(v) for v in value)
    if isinstance(value, list):
        return [plain(v) for v in value]
    return value


@pytest.fixture(scope="session")
def check(spark):
    """Evaluates (Column, expected) pairs over one row, all in one query."""

    def run(*pairs):
        row = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(pairs)]).first()
        wrong = [(i, got, want) for i, (got, (_, want)) in enumerate(zip(map(plain, row), pairs)) if got != want]
        assert not wrong, wrong

    return run


@pytest.fixture(scope="session")
def strings(spark):
    """A table (i, s) of strings in order."""

    def make(*values):
        return spark.createDataFrame([(i, v) for i, v in enumerate(values, 1)], "i int, s string")

    return make

