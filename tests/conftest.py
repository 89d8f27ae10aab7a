import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def pytest_addoption(parser):
    parser.addoption("--slow", action="store_true", help="also the queries that take long")


def pytest_configure(config):
    config.addinivalue_line("markers", "slow: runs with --slow only")


def pytest_collection_modifyitems(config, items):
    if not config.getoption("--slow"):
        for item in items:
            if "slow" in item.keywords:
                item.add_marker(pytest.mark.skip(reason="needs --slow"))


@pytest.fixture(scope="session")
def spark():
    from pledgetrace.session import local_session
    session = local_session("pledgetrace-tests", 4)
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Value of a column expression over a single row of named values."""
    def value(column, **values):
        from pyspark.sql import functions as F
        row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or ["id"])
        return row.select(column.alias("v")).first()["v"]
    return value
