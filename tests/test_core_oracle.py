"""Every core query with SQL against DuckDB at the smallest scale."""

from __future__ import annotations

import pytest

from factloom.plans.oracle import ORACLE
from factloom.plans.queries import QUERIES
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
    df = QUERIES[name](spark, f"/root/testdata/{SF}")
    assert df.columns
    df.count()
