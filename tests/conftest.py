import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from timelinekit.session import HOT_ROWS_KEY, build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "4", 4)
    yield session
    session.stop()


@pytest.fixture()
def tiny_limit(spark):
    """Every key above 20 rows counts as hot, so the chunked plans run."""
    spark.conf.set(HOT_ROWS_KEY, "20")
    yield 20
    spark.conf.unset(HOT_ROWS_KEY)
