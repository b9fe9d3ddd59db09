"""Queries that SQL can express, against their SQL."""

import oracle
import pytest

from sunloom.llm.queries import ORACLES, PLANS


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, small, name):
    got = PLANS[name](spark, small).toPandas()
    assert oracle.differences(got, oracle.connect(small).execute(ORACLES[name]).df()) == []
