"""Every registered batch query plans without cartesian or nested-loop joins and
without Python evaluation: all work stays in JVM operators."""

import pytest

from conftest import SF_SMALL
from railyard.registry import QUERIES

FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas"]
WRITES = {"report_export", "report_catalog", "append_log", "job_feed_stream"}  # run a write while planning


@pytest.mark.parametrize("key", sorted(set(QUERIES) - WRITES))
def test_plan_is_jvm_only_without_cross_joins(spark, key):
    df = QUERIES[key](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for op in FORBIDDEN:
        assert op not in plan, f"{key}: {op}"
