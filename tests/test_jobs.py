import datetime as dt

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from railyard.functions.enums import enum_max
from railyard.functions.timefmt import duration_text
from railyard.operators import jobs as JB
from railyard.schemas import ENUMS

SCHEMA = "job_name string, ts timestamp, event_id long, active int, succeeded int, failed int, " \
         "creation_ts timestamp, start_ts timestamp, completion_ts timestamp"


def _t(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def _obs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_classify_precedence(spark):
    rows = [("j", _t(i), i, a, s, f, None, None, None) for i, (a, s, f) in enumerate(
        [(1, 1, 1), (1, None, 1), (1, 0, 0), (0, 0, 0), (None, None, None)])]
    got = [r.status for r in JB.classify(_obs(spark, rows)).orderBy("event_id").collect()]
    assert got == ["Succeeded", "Failed", "Running", "Pending", None]


def test_changes_first_row_and_diff(spark):
    rows = [("j", _t(0), 0, 1, 0, 0, None, None, None), ("j", _t(2), 1, 1, 0, 0, None, None, None),
            ("j", _t(4), 2, 2, 0, 0, None, None, None), ("j", _t(86400 * 2), 3, 2, 0, 0, None, None, None),
            ("j", _t(86400 * 3), 4, 0, 1, 0, None, None, _t(86400 * 3))]
    got = [r.event_id for r in JB.changes(_obs(spark, rows)).orderBy("event_id").collect()]
    assert got == [0, 2, 4]   # day borders are stitched: event 3 equals event 2


def test_terminal_retention(spark):
    rows = [("j", _t(0), 0, 1, 0, 0, None, None, None), ("j", _t(10), 1, 0, 0, 1, None, None, None),
            ("j", _t(20), 2, 1, 0, 1, None, None, None), ("j", _t(60), 3, 0, 1, 0, None, None, None)]
    got = [(r.event_id, r.monitoring) for r in JB.terminal_feed(_obs(spark, rows)).orderBy("event_id", "monitoring").collect()]
    assert got == [(0, True), (1, False), (1, True), (2, True)]


def test_latest_and_counts(spark):
    rows = [("a", _t(0), 0, 1, 0, 0, None, None, None), ("a", _t(5), 1, 0, 1, 0, None, None, None),
            ("b", _t(1), 2, 1, 0, 0, None, None, None), ("c", _t(1), 3, 0, 0, 0, None, None, None)]
    c = JB.status_counts(JB.latest(_obs(spark, rows))).collect()[0]
    assert (c.n_jobs, c.running, c.succeeded, c.failed) == (3, 1, 1, 0)


def test_duration_text(spark):
    df = spark.createDataFrame([(None,), (0,), (59,), (60,), (3725,)], "s long")
    assert [r[0] for r in df.select(duration_text(F.col("s"))).collect()] == ["0s", "0s", "59s", "1m 0s", "62m 5s"]


def test_durations(spark):
    rows = [("a", _t(100), 0, 1, 0, 0, _t(0), _t(10), None), ("b", _t(100), 1, 0, 1, 0, _t(0), None, None),
            ("c", _t(100), 2, 0, 1, 0, _t(0), _t(10), _t(75))]
    out = {r.job_name: r for r in JB.with_durations(JB.latest(_obs(spark, rows)), _t(130)).collect()}
    assert out["a"].duration_seconds == 120 and out["b"].duration_seconds == 0
    assert out["c"].duration_seconds == 65 and out["c"].duration_text == "1m 5s"
    assert out["c"].completion_time == "2024-01-01T00:01:15Z"


def test_preferred_pod(spark):
    pods = spark.createDataFrame([("x", 1, "Failed"), ("x", 2, "Running"), ("x", 3, "Succeeded"),
                                  ("y", 5, "Pending"), ("y", 4, "Failed")], "name string, id int, status string")
    got = {r.name: r.id for r in JB.preferred_pod(pods).collect()}
    assert got == {"x": 2, "y": 4}


def test_missing_jobs(spark):
    rows = [("a", _t(0), 0, 1, 0, 0, None, None, None), ("a", _t(3600), 1, 1, 0, 0, None, None, None),
            ("b", _t(0), 2, 1, 0, 0, None, None, None), ("b", _t(7200), 3, 1, 0, 0, None, None, None)]
    got = sorted((r.job_name, r.event_id) for r in JB.missing_jobs(_obs(spark, rows)).collect())
    # b comes back after its gap: reported once; nothing follows the last snapshot
    assert got == [("a", 1), ("b", 2)]
    ended = rows + [("c", _t(0), 4, 0, 1, 0, None, None, None)]
    assert "c" not in {r.job_name for r in JB.missing_jobs(_obs(spark, ended)).collect()}


@settings(max_examples=20, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ENUMS["payment_status"] + [None]), min_size=1, max_size=6),
                min_size=1, max_size=5))
def test_enum_max_matches_python(spark, groups):
    rows = [(g, s) for g, vals in enumerate(groups) for s in vals]
    df = spark.createDataFrame(rows, "g int, s string")
    got = {r.g: r.m for r in df.groupBy("g").agg(enum_max("s", "payment_status").alias("m")).collect()}
    order = ENUMS["payment_status"]
    for g, vals in enumerate(groups):
        present = [v for v in vals if v is not None]
        assert got[g] == (max(present, key=order.index) if present else None)


def test_iso_utc_independent_of_session_zone(spark):
    from railyard.functions.timefmt import iso_utc
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 12, 0, 5),)], "ts timestamp")
    prev = spark.conf.get("spark.sql.session.timeZone")
    try:
        got = []
        for tz in ["UTC", "America/New_York", "Asia/Tokyo"]:
            spark.conf.set("spark.sql.session.timeZone", tz)
            got.append(df.select(iso_utc(F.col("ts"))).collect()[0][0])
    finally:
        spark.conf.set("spark.sql.session.timeZone", prev)
    assert len(set(got)) == 1
