import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def spread(spark):
    """Every group counts as too large for one window."""
    spark.conf.set("spark.tallyloom.windowRows", "2")
    yield spark
    spark.conf.unset("spark.tallyloom.windowRows")
