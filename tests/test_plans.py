"""Plan shape: the properties the design relies on at scale, checked on executed plans."""

import pytest

from conftest import SF_SMALL

import __spark_entry__ as E


def executed(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    q = E.queries()
    names = ["master_dataset", "forecast_mean", "score_requests_mean", "snapshot_many_dates",
             "training_features", "court_case_summary"]
    return {n: executed(q[n](spark, SF_SMALL)) for n in names}


def test_no_cartesian_or_nested_loop_joins(plans):
    for name, plan in plans.items():
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name


def test_milestones_and_counts_are_pre_aggregated(plans):
    m = plans["master_dataset"]
    # map-side partial aggregates feed the per-project shuffles
    assert "partial_min(date_37A" in m
    assert "partial_count(" in m or "partial_count(1)" in m
    c = plans["court_case_summary"]
    assert "partial_sum(" in c


def test_row_local_plans_have_no_shuffle(plans):
    for name in ["forecast_mean", "score_requests_mean", "training_features"]:
        assert "Exchange hashpartitioning" not in plans[name], name
        assert "Exchange rangepartitioning" not in plans[name], name


def test_no_python_in_any_plan(plans):
    for name, plan in plans.items():
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name


def test_snapshot_windows_are_partitioned(plans):
    s = plans["snapshot_many_dates"]
    assert "Exchange SinglePartition" not in s
    assert "Window [" in s
