import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from trailmill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def evaluate(spark):
    """Evaluate one SQL expression per text value, named ``v``."""

    def run(expression, values):
        rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
        return [r[0] for r in rows.orderBy("i").selectExpr(f"{expression} AS r").collect()]

    return run
