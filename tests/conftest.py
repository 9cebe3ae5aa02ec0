import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from marketladder.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("8", "tests")


@pytest.fixture(scope="session")
def rows(spark):
    """Collect a frame as a sorted list of plain tuples."""

    def collect(df, *columns):
        found = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
        return sorted(found, key=repr)

    return collect
