"""Plans are what they are meant to be: filters and columns reach the scan, and no Python runs."""

import pytest

from tidemark.plans import queries as plans

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return plans.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


#: Queries that show registered Python functions in SQL; each has a native twin.
PYTHON = {"udaf_avg_sql", "table_agg_top2_sql"}


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - PYTHON))
def test_no_python(spark, name):
    p = plan(spark, name)
    assert not any(x in p for x in ("EvalPython", "InPandas", "InArrow", "CartesianProduct", "ExistingRDD")), p


def test_filter_and_columns_reach_the_scan(spark):
    p = plan(spark, "page_view_hourly")
    assert "EqualTo(event_type,view)" in p and "ReadSchema: struct<ts:timestamp_ntz,event_type:string>" in p
    p = plan(spark, "upsert_latest")
    assert "props" not in p.split("ReadSchema")[1]


def test_top_n_limits_before_the_shuffle(spark):
    p = plan(spark, "hot_items_topn")
    assert "WindowGroupLimit" in p and p.count("Exchange hashpartitioning") == 3


def test_sliding_counts_aggregate_before_they_spread(spark):
    p = plan(spark, "channel_behavior_counts")
    assert p.index("Expand") < p.rindex("HashAggregate") if "Expand" in p else p.count("HashAggregate") >= 4


def test_as_of_join_is_one_shuffle_of_both_sides(spark):
    p = plan(spark, "asof_version_join")
    assert "Join" not in p and "Window" in p
