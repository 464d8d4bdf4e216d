"""Physical plans: no all-pairs joins, no row-at-a-time Python, filters and columns reach the scan."""

import pytest

from freshet.plans.catalogue import QUERIES
from freshet.sources import readings

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"som_sweep", "kmeans_elbow", *(q for q in QUERIES if q.startswith("sweep_"))}))
def test_no_costly_nodes(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    costly = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"]
    if name != "node_clusters":  # one group per run, bounded by the lattice
        costly.append("FlatMapGroupsInPandas")
    assert [node for node in costly if node in text] == []


def test_scan_reads_only_what_is_needed(spark):
    text = plan(readings.runoff(spark, FOLDER))
    assert "In(l_returnflag, [A,R])" in text
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string,l_shipdate:timestamp_ntz>" in text


def test_daily_aggregation_combines_before_the_shuffle(spark):
    text = plan(readings.runoff(spark, FOLDER))
    assert text.count("HashAggregate") >= 2 and "partial_sum" in text


def test_top_k_is_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(QUERIES["topk_group"](spark, FOLDER))
