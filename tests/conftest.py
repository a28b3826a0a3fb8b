import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lexigraph.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate a column over one text: ``one(text, lambda c: column)``."""
    from pyspark.sql import functions as F

    def run(text, build):
        return spark.createDataFrame([(text,)], "t string").select(build(F.col("t")).alias("x")).first()["x"]

    return run
