"""Plan checks: no Python UDF, no cartesian product, pushed filters, top-k operator."""

import re

import pytest

from conftest import SF_SMALL
from thali import catalog

FORBIDDEN = ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalog.REGISTRY))
def test_no_udf_or_cartesian(spark, name):
    plan = _plan(catalog.run(name, spark, SF_SMALL))
    for bad in FORBIDDEN:
        assert bad not in plan, f"{name}: {bad}"
    # every window is partitioned (a global window would pull all rows into one task)
    assert not re.search(r"Window \[.*\], \[\], \[", plan), f"{name}: unpartitioned window"


def test_period_filter_reaches_scan(spark):
    plan = _plan(catalog.run("best_sellers_month", spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan
    assert "TakeOrderedAndProject" in plan


def test_scan_reads_only_needed_columns(spark):
    plan = _plan(catalog.run("sales_overview", spark, SF_SMALL))
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double>" in plan


@pytest.mark.parametrize("name", sorted(catalog.REGISTRY))
def test_no_nested_loop_at_scale_posture(spark, name):
    """With automatic broadcast off (as when every table is large), no plan may fall back
    to a nested-loop or cartesian join."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(catalog.run(name, spark, SF_SMALL))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
