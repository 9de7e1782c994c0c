"""Physical-plan properties the report relies on at scale."""

import datetime as dt

from railyard.plans import report as R
from pyspark.sql import functions as F

from railyard.plans.window import Window, in_window
from railyard.sources.tables import ParquetDomain, write_domain


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_window_filter_pushed_to_stored_tickets(spark, adapter_small, tmp_path):
    write_domain(adapter_small, str(tmp_path), names=["tickets"])
    pq = ParquetDomain(spark, str(tmp_path))
    t = pq["tickets"].filter(in_window(F.col("issued_at"), Window(dt.date(1998, 1, 1), dt.date(1998, 1, 31))))
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(issued_at), GreaterThanOrEqual(issued_at" in plan
    assert "LessThan(issued_at" in plan


def test_report_broadcasts_small_dims(spark, adapter_small):
    rep = R.ticket_report(adapter_small, Window(dt.date(1998, 1, 1), dt.date(1998, 1, 31)), ordered=False)
    plan = rep._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 3  # routes, departure and arrival stations


def test_payments_pruned_to_window_bookings(spark, adapter_small):
    rep = R.ticket_report(adapter_small, Window(dt.date(1998, 1, 1), dt.date(1998, 1, 31)), ordered=False)
    opt = rep._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in opt


def test_change_detection_partitions_by_job_and_bucket(spark, adapter_small):
    from railyard.operators import jobs as JB
    plan = JB.changes(adapter_small.job_observations())._jdf.queryExecution().executedPlan().toString()
    # the per-observation window runs per (job, day), never over a job's whole history;
    # only the one-row-per-(job, day) carry summary is windowed per job
    lag = [ln for ln in plan.split("\n") if "AS __lag" in ln]
    carry = [ln for ln in plan.split("\n") if "AS __carry" in ln]
    partition_spec = lag[0].split("AS __lag")[1].split("], [")[1] if len(lag) == 1 else ""
    assert partition_spec.startswith("job_name") and "__bkt" in partition_spec
    assert len(carry) == 1


def test_latest_state_is_an_aggregate_not_a_window(spark, adapter_small):
    from railyard.operators import jobs as JB
    plan = JB.latest(adapter_small.job_observations())._jdf.queryExecution().executedPlan().toString()
    assert "max_by" in plan and "Window" not in plan
    assert "partial_max_by" in plan  # map-side partial aggregation before the shuffle


def test_unused_left_joins_are_not_built(spark, adapter_small):
    w = Window(dt.date(1998, 1, 1), dt.date(1998, 3, 31))
    cols = ["ticket_ref", "route_code", "fare_code"]
    part = R.ticket_report(adapter_small, w, columns=cols)
    full = R.ticket_report(adapter_small, w).select(*cols)
    assert sorted(tuple(r) for r in part.collect()) == sorted(tuple(r) for r in full.collect())
    plan = part._jdf.queryExecution().optimizedPlan().toString()
    full_plan = R.ticket_report(adapter_small, w)._jdf.queryExecution().optimizedPlan().toString()
    # bookings (orders), passengers (c_mktsegment) and trains (s_name) are not read at all
    for src in ["o_orderstatus", "c_mktsegment", "s_name"]:
        assert src in full_plan and src not in plan
    assert "p_retailprice" in plan or "p_name" in plan   # the fare join stays
    import pytest
    with pytest.raises(ValueError):
        R.ticket_report(adapter_small, w, columns=["nope"])
