import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from tickloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """Rows with a schema string; timestamps may be given as text."""

    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    return make
