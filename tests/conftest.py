import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stopfield.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "stopfield-tests")


@pytest.fixture
def rows(spark):
    """Rows of a frame as sorted plain tuples, numbers rounded."""

    def plain(v):
        return round(v, 6) if isinstance(v, float) else v

    return lambda df, *cols: sorted(
        (tuple(plain(v) for v in r) for r in df.select(*(cols or df.columns)).collect()), key=lambda t: tuple((v is None, str(v)) for v in t)
    )
