"""The streaming feeds = their batch twins: over triggers, restarts, busy jobs and late rows; state stays bounded."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from railyard.operators import jobs as JB
from railyard.sources.adapter import StarAdapter
from railyard.sources.ranged import RangedTable
from railyard.streaming.job_feed import (OBSERVATION_SCHEMA, POLL_SCHEMA, LatestStateWriter, TotalsSink, change_feed, change_points,
                                         heartbeat, latest_states, missing_feed, read_snapshots, start_change_feed,
                                         status_changes, streaming_session)

DAYS = [(1, 11), (11, 21), (21, 32)]
T0 = dt.datetime(2024, 1, 1)
YEAR = 366 * 86400


@pytest.fixture(scope="module")
def obs(spark):
    return StarAdapter(spark, SF_MID).job_observations().select(*[f.name for f in OBSERVATION_SCHEMA.fields]).persist()


@pytest.fixture(scope="module")
def stream(spark):
    return streaming_session(spark, 4)


def _at(s):
    return T0 + dt.timedelta(seconds=s)


def _observed(spark, rows):
    """Observations from (job, second, event id, active, succeeded, failed)."""
    return spark.createDataFrame([(j, "ns", _at(s), i, a, ok, f, T0, T0, None, None) for j, s, i, a, ok, f in rows], OBSERVATION_SCHEMA)


def _write_snapshots(obs, folder, parts):
    for i, (a, b) in parts:
        (obs.filter((F.dayofmonth("ts") >= a) & (F.dayofmonth("ts") < b))
            .coalesce(1).write.parquet(os.path.join(folder, f"snap-{i:03d}")))


def _close(spark, folder, at=dt.datetime(2024, 3, 1)):
    heartbeat(spark, at).coalesce(1).write.parquet(os.path.join(folder, "heartbeat"))


def _run(stream, src, ckpt, out, one_file=True, **options):
    s = read_snapshots(stream, src, 1 if one_file else None)
    q = (change_feed(s, **{"slice": "1 hour", "tombstone_s": YEAR, **options}).writeStream.format("parquet").option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start(out))
    q.awaitTermination()
    return q


def _key(df):
    return sorted(tuple(r) for r in df.select("job_name", "event_id", "status", "monitoring").collect())


# change feed ---------------------------------------------------------------------
def test_stream_equals_batch_with_restart(spark, stream, obs, tmp_path):
    src, ckpt, out = str(tmp_path / "src"), str(tmp_path / "ckpt"), str(tmp_path / "out")
    _write_snapshots(obs, src, list(enumerate(DAYS))[:2])
    _run(stream, src, ckpt, out)
    _write_snapshots(obs, src, list(enumerate(DAYS))[2:])   # new files after a stop
    _close(spark, src)
    _run(stream, src, ckpt, out)                             # restart from the checkpoint
    assert _key(spark.read.parquet(out)) == _key(JB.terminal_feed(obs))


def test_open_slices_wait_for_the_watermark(spark, stream, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    _observed(spark, [("a", 0, 0, 1, 0, 0), ("a", 59, 1, 2, 0, 0), ("a", 200, 2, 3, 0, 0)]).coalesce(1).write.parquet(src + "/s0")
    _run(stream, src, str(tmp_path / "ck"), out, slice="1 minute")
    assert [r[1] for r in _key(spark.read.parquet(out))] == [0, 1]
    _close(spark, src)
    _run(stream, src, str(tmp_path / "ck"), out, slice="1 minute")
    assert [r[1] for r in _key(spark.read.parquet(out))] == [0, 1, 2]


@pytest.mark.parametrize("slice", ["5 seconds", "1 minute"])
def test_rearm_within_retention_batch_equals_stream(spark, stream, tmp_path, slice):
    # (second, active, succeeded, failed); the second case ends twice by an unchanged terminal row in a slice of its own
    seq = [(0, 1, 0, 0), (10, 0, 0, 1), (15, 1, 0, 1), (20, 1, 0, 1), (25, 0, 1, 0), (38, 0, 1, 0), (45, 1, 0, 0)]
    obs = _observed(spark, [("j", s, i, *c) for i, (s, *c) in enumerate(seq)])
    expected = [(0, True), (1, False), (1, True), (2, True), (3, False), (4, True), (5, False)]
    assert sorted((r.event_id, r.monitoring) for r in JB.terminal_feed(obs).collect()) == expected
    src = str(tmp_path / "src")
    obs.coalesce(1).write.parquet(src + "/s0")
    _close(spark, src)
    _run(stream, src, str(tmp_path / "ckpt"), str(tmp_path / "out"), slice=slice)
    got = sorted((r.event_id, r.monitoring) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == expected


def test_shuffled_snapshot_files(spark, stream, obs, tmp_path):
    src = str(tmp_path / "src")
    _write_snapshots(obs, src, [(i, DAYS[d]) for i, d in enumerate([2, 0, 1])])     # files land out of time order, one trigger
    _run(stream, src, str(tmp_path / "ck"), str(tmp_path / "out"), one_file=False)
    _close(spark, src)
    _run(stream, src, str(tmp_path / "ck"), str(tmp_path / "out"))
    assert _key(spark.read.parquet(str(tmp_path / "out"))) == _key(JB.terminal_feed(obs))


def test_late_rows_are_dropped_and_do_not_fail(spark, stream, tmp_path):
    hour = 3600
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    _observed(spark, [("a", 0, 0, 1, 0, 0), ("a", 10 * hour, 1, 1, 0, 0)]).coalesce(1).write.parquet(src + "/f1")
    _run(stream, src, str(tmp_path / "ck"), out, slice="1 minute")
    _observed(spark, [("b", hour, 2, 1, 0, 0), ("b", 2 * hour, 3, 0, 1, 0), ("a", 11 * hour, 4, 0, 1, 0)]).coalesce(1).write.parquet(src + "/f2")
    _run(stream, src, str(tmp_path / "ck"), out, slice="1 minute")
    _close(spark, src)
    _run(stream, src, str(tmp_path / "ck"), out, slice="1 minute")
    got = [(r.job_name, r.event_id, r.monitoring) for r in spark.read.parquet(out).collect()]
    assert sorted(got) == [("a", 0, True), ("a", 4, False), ("a", 4, True)]


def test_one_busy_job_spreads_over_tasks(spark, stream, tmp_path):
    """A job with all rows of a trigger: its slices lie in many partitions, and few rows reach the state per job."""
    n = 30_000
    obs = spark.range(n).select(
        F.lit("busy").alias("job_name"), F.lit("ns").alias("namespace"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts"),
        F.col("id").alias("event_id"), (F.floor(F.col("id") / 100) % 2 + 1).cast("int").alias("active"), F.lit(0).alias("succeeded"),
        F.lit(0).alias("failed"), F.lit(None).cast("timestamp").alias("creation_ts"), F.lit(None).cast("timestamp").alias("start_ts"),
        F.lit(None).cast("timestamp").alias("completion_ts"), F.lit(None).cast("map<string,string>").alias("labels"))
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    obs.orderBy(F.xxhash64("event_id")).coalesce(1).write.parquet(src + "/s0")
    _close(spark, src)
    _run(stream, src, str(tmp_path / "ck"), out, one_file=False, slice="10 minutes")
    got = spark.read.parquet(out)
    assert got.count() == 300 and _key(got) == _key(JB.terminal_feed(obs))
    merge = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merge, "false")
    try:
        points = change_points(obs, "10 minutes").withColumn("task", F.spark_partition_id())
        tasks, kept = points.agg(F.count_distinct("task"), F.count("*")).first()
    finally:
        spark.conf.set(merge, "true")
    assert tasks >= 6 and kept < n / 20


def _state_rows(q, operator=0):
    """Rows that the state per job holds after the last trigger (the last operator of the chain comes first)."""
    return [p["stateOperators"][operator]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]


def test_state_is_bounded_and_a_name_starts_anew(spark, stream, tmp_path):
    """One job after another ends; their states go, and later their names."""
    src, ckpt, out = str(tmp_path / "src"), str(tmp_path / "ck"), str(tmp_path / "out")
    day, totals = 86400, []
    for d in range(6):
        rows = [(f"job-{d}-{k}", d * day + k, k, 0, 1, 0) for k in range(20)] + ([("job-0-0", 5 * day + 50, 99, 0, 1, 0)] if d == 5 else [])
        _observed(spark, rows).coalesce(1).write.parquet(f"{src}/d{d}")
        q = _run(stream, src, ckpt, out, slice="1 minute", tombstone_s=day)
        totals.append(_state_rows(q)[-1])
    _close(spark, src, T0 + dt.timedelta(days=30))
    q = _run(stream, src, ckpt, out, slice="1 minute", tombstone_s=day)
    assert max(totals) <= 2 * 2 * 20 + 40 and _state_rows(q)[-1] <= 21
    got = _key(spark.read.parquet(out))
    assert len(got) == 2 * (6 * 20 + 1)
    assert [r for r in got if r[0] == "job-0-0"].count(("job-0-0", 99, "Succeeded", False)) == 1


def test_start_change_feed_writes_records_and_latest(spark, obs, tmp_path):
    src = str(tmp_path / "src")
    _write_snapshots(obs, src, list(enumerate(DAYS)))
    _close(spark, src)
    q = start_change_feed(spark, src, str(tmp_path / "out"), str(tmp_path / "ckpt"), available_now=True, max_files_per_trigger=2)
    q.awaitTermination()
    records = spark.read.parquet(str(tmp_path / "out" / "records")).drop("batch")
    exp = JB.terminal_feed(obs)
    first_end = exp.filter("not monitoring").groupBy("job_name").agg(F.min("ts").alias("end"))
    # the default tombstone is a day: compare up to a job's retention
    upto = lambda df: _key(df.join(first_end, "job_name", "left").filter("end is null or ts <= end + interval 30 seconds"))
    assert upto(records) == _key(exp)
    latest = LatestStateWriter(str(tmp_path / "out" / "latest")).current(spark)
    want = records.groupBy("job_name").agg(F.max_by("event_id", F.struct("ts", "event_id", ~F.col("monitoring"))).alias("e"))
    assert sorted(tuple(r) for r in latest.select("job_name", "event_id").collect()) == sorted(tuple(r) for r in want.collect())


# totals --------------------------------------------------------------------------
@pytest.mark.parametrize("triggers", [1, 3])
def test_totals_by_retraction(spark, stream, obs, tmp_path, triggers):
    src = str(tmp_path / "src")
    sink = TotalsSink(str(tmp_path / "totals"))
    assert sink.current(spark).count() == 0

    def run():
        q = (status_changes(read_snapshots(stream, src), "1 hour").writeStream.foreachBatch(sink)
             .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
        q.awaitTermination()
    for i, part in enumerate(DAYS):
        _write_snapshots(obs, src, [(i, part)])
        if triggers > 1:
            run()
    _close(spark, src)
    run()
    got = {r.status: r.n for r in sink.current(spark).collect()}
    assert got == {r.status: r["count"] for r in JB.latest(obs).groupBy("status").count().collect()}
    assert sorted(os.listdir(tmp_path / "totals")) == ["slot-0", "slot-1"]


def test_totals_sink_replays(spark, tmp_path):
    sink = TotalsSink(str(tmp_path / "t"))

    def batch(n, *rows):
        sink(spark.createDataFrame(list(rows), "status string, change long"), n)
        return {r.status: r.n for r in sink.current(spark).collect()}
    assert batch(0, ("Running", 1), ("Running", 1), (None, 1)) == {"Running": 2, None: 1}
    assert batch(1, ("Running", -1), ("Failed", 1)) == {"Running": 1, "Failed": 1, None: 1}
    assert batch(1, ("Running", -1), ("Failed", 1)) == {"Running": 1, "Failed": 1, None: 1}   # replayed
    assert batch(2) == {"Running": 1, "Failed": 1, None: 1}                                   # nothing changed
    assert batch(3, (None, -1), ("Running", -1)) == {"Failed": 1}


# missing jobs --------------------------------------------------------------------
def test_missing_jobs_against_polls(spark, stream, tmp_path):
    """gone: answered without it; failed: only failed polls; unpolled: none at all; ended: no longer watched;
    back: reported once although it returns; late: first seen after polls that did not find it."""
    h = 3600
    obs = _observed(spark, [(j, 10, i, 1, 0, 0) for i, j in enumerate(["gone", "failed", "unpolled", "back"])] + [
        ("gone", 20, 10, 2, 0, 0), ("ended", 30, 11, 0, 1, 0), ("back", 3 * h + 5, 12, 1, 0, 0), ("late", 2 * h + 5, 13, 1, 0, 0),
        ("late", 3 * h + 5, 14, 1, 0, 0)])
    answered = {"gone": {0: True, 1: False, 2: True, 3: True}, "failed": {0: True, 1: False, 2: False}, "unpolled": {0: True}, "ended": {0: True, 1: True},
                "back": {0: True, 2: True, 3: True, 4: True}, "late": {0: True, 1: True, 2: True, 3: True}}
    polls = [(j, _at(p * h), ok) for j, of in answered.items() for p, ok in of.items()]
    src = str(tmp_path)

    def run():
        s = stream.readStream.schema(POLL_SCHEMA).option("recursiveFileLookup", "true").parquet(src + "/polls")
        q = (missing_feed(s, read_snapshots(stream, src + "/obs")).writeStream.format("parquet")
             .option("checkpointLocation", src + "/ck").trigger(availableNow=True).start(src + "/out"))
        q.awaitTermination()
    for i, (a, b) in enumerate([(0, 2), (2, 4), (4, 6)]):     # in three triggers
        obs.filter(F.col("ts").between(F.lit(_at(a * h)), F.lit(_at(b * h - 1)))).coalesce(1).write.parquet(f"{src}/obs/{i}")
        spark.createDataFrame([p for p in polls if _at(a * h) <= p[1] < _at(b * h)], POLL_SCHEMA).coalesce(1).write.parquet(f"{src}/polls/{i}")
        run()
    heartbeat(spark, _at(48 * h)).coalesce(1).write.parquet(src + "/obs/end")
    spark.createDataFrame([("", _at(48 * h), False)], POLL_SCHEMA).coalesce(1).write.parquet(src + "/polls/end")
    run()
    got = sorted((r.job_name, r.missing_at, r.event_id, r.status, r.monitoring) for r in spark.read.parquet(src + "/out").collect())
    assert got == [("back", _at(2 * h), 3, "Running", False), ("gone", _at(2 * h), 10, "Running", False)]


# latest states and key ranges ----------------------------------------------------
def test_latest_states_in_update_mode(spark, stream, obs, tmp_path):
    src, sink = str(tmp_path / "src"), LatestStateWriter(str(tmp_path / "latest"), ranges=16)
    assert sink.current(spark) is None
    for i, part in enumerate(reversed(DAYS)):            # later days first: order does not matter
        _write_snapshots(obs, src, [(i, part)])
        q = (latest_states(read_snapshots(stream, src)).writeStream.outputMode("update").foreachBatch(sink)
             .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
        q.awaitTermination()
    cols = ["job_name", "event_id", "status", "ts"]
    key = lambda df: sorted(tuple(r) for r in df.select(*cols).collect())
    assert key(sink.current(spark)) == key(JB.latest(obs))


def _files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(f"{root}/rows") for f in fs if f.startswith("part")}


def test_an_upsert_rewrites_only_the_ranges_of_its_keys(spark, tmp_path):
    root = str(tmp_path / "t")
    t = RangedTable(spark, root, spark.range(0).selectExpr("id", "0 as v", "'' as s").schema, "id", ranges=32)
    t.create(spark.range(10_000).selectExpr("id", "0 as v", "cast(id as string) as s"))
    before = _files(root)
    changes = spark.createDataFrame([(5, 1, "new"), (5, 2, "newer"), (20_000, 1, None), (7, -1, "older")], "id long, v int, s string")
    touched = t.upsert(changes, F.col("v"))
    after = _files(root)
    assert 1 <= len(touched) <= 3
    rewritten = {p.split("_range=")[1].split("/")[0] for p in set(before) ^ set(after)}
    assert rewritten <= {str(r) for r in touched}
    assert sum(before.get(p) == m for p, m in after.items()) >= 29
    rows = {r.id: (r.v, r.s) for r in t.read().filter("id in (5, 7, 20000) or id = 9").collect()}
    assert rows == {5: (2, "newer"), 7: (0, "7"), 9: (0, "9"), 20_000: (1, None)} and t.read().count() == 10_001


def test_a_lost_writer_is_finished_by_the_replay(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    t = RangedTable(spark, root, spark.range(0).selectExpr("id", "0 as v").schema, "id", ranges=4)
    t.create(spark.range(100).selectExpr("id", "0 as v"))
    put = RangedTable._put

    def lost(self, df):
        # the driver goes after the first partition has been removed and before the new ones are in place
        victim = sorted(d for d in os.listdir(self.rows) if d.startswith("_range="))[0]
        for f in os.listdir(f"{self.rows}/{victim}"):
            os.truncate(f"{self.rows}/{victim}/{f}", 0)
        raise RuntimeError("lost")
    monkeypatch.setattr(RangedTable, "_put", lost)
    changes = spark.range(100).selectExpr("id", "cast(id % 3 as int) as v")
    with pytest.raises(RuntimeError):
        t.upsert(changes, F.col("v"), batch=7)
    monkeypatch.setattr(RangedTable, "_put", put)
    t.upsert(changes, F.col("v"), batch=7)
    t.upsert(changes, F.col("v"), batch=7)               # and once more
    assert sorted(tuple(r) for r in t.read().collect()) == [(i, i % 3) for i in range(100)]
