import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from spanloom.runtime import local_session

    session = local_session(4, "tests")
    # Compiling each plan takes far longer than running it on a few rows.
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    session.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    return session


@pytest.fixture
def hot(spark):
    """Treat every group of more than a few rows as too large for one task."""
    from spanloom.operators.ordered import HOT_ROWS, HOT_ROWS_CONF

    spark.conf.set(HOT_ROWS_CONF, "7")
    yield
    spark.conf.set(HOT_ROWS_CONF, str(HOT_ROWS))
