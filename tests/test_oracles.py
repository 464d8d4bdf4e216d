"""Every query SQL can express, against another engine on the same tables."""

import pytest

from freshet.plans.catalogue import QUERIES
from oracles import ORACLES
from tests.compare import connect, differences

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(ORACLES))
def test_same_result(spark, con, name):
    assert differences(QUERIES[name](spark, FOLDER), con, ORACLES[name]) == []


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_and_repeats(spark, name):
    """Queries without SQL form give rows, and the same rows again."""
    first = QUERIES[name](spark, FOLDER).toPandas()
    again = QUERIES[name](spark, FOLDER).toPandas()
    order = list(first.columns)
    assert len(first) > 0
    a = first.sort_values(order).reset_index(drop=True)
    assert a.equals(again.sort_values(order).reset_index(drop=True))
