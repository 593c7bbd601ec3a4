import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from millrace.session import local_session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", "4", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    return s


@pytest.fixture
def rows():
    """The rows of a frame as a sorted list of tuples, nulls first."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=lambda t: [(x is not None, str(type(x)), x if x is not None else 0) for x in t])
