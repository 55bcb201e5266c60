import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from textloom.session import local_session

    return local_session(cores=8, shuffle_partitions=4)


@pytest.fixture(scope="session")
def rows():
    """Rows of a table as a sorted list of tuples, nulls first."""

    def get(df):
        return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))

    return get
