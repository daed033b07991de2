import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from postlens.session import build_session  # noqa: E402


# Started here, as test modules build column expressions when they are imported.
SESSION = build_session("postlens-tests", "local[8]", 8, "8g")
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture(scope="session")
def column(spark):
    """Values of an expression over a one-column frame of inputs, in input order."""
    def run(values, expression, kind="string"):
        frame = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
        return [r["y"] for r in frame.select("i", expression.alias("y")).orderBy("i").collect()]

    return run
