import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from credsieve.functions.rules import builtin_rules  # noqa: E402
from credsieve.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "credsieve-tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def rules():
    return builtin_rules()


@pytest.fixture
def fresh_dir():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


@pytest.fixture(scope="session")
def evaluate(spark):
    """Evaluate SQL expressions over named columns of a few rows."""

    def run(rows, schema, *exprs):
        df = spark.createDataFrame(rows, schema)
        return [tuple(r) for r in df.selectExpr(*exprs).collect()]

    return run
