"""Every query of the llm folder: against DuckDB where it has SQL, else that it runs."""

from __future__ import annotations

import pytest

from factloom.llm.oracle import ORACLE
from factloom.llm.queries import QUERIES
from tests.oracle import compare, connect

SF = "sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, con, name):
    compare(spark, con, QUERIES[name], ORACLE[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, f"/root/testdata/{SF}").count() >= 0


def test_larger_overlaps(spark):
    """At sf0.1 the hot pair of names has pairs near the border of similarity."""
    compare(spark, connect("sf0.1"), QUERIES["p1_found"], ORACLE["p1_found"], "sf0.1")
