"""One local session for all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from factloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "4g", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture
def rows():
    """A DataFrame's rows as sorted tuples of its columns in order."""

    def get(df, *cols):
        return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()), key=lambda r: tuple((x is not None, str(x)) for x in r))

    return get
