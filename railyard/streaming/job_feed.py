"""Job-status change feed on Structured Streaming.

Snapshot files of job observations arrive in a folder (the monitor polls every
2 s; here each file is one or more polls).  All feeds are chains of stateful
operators in append mode, so that no job's history meets in one task:

* a watermarked aggregation per (job, time slice), built-in, reduces a slice to
  what the job's state can depend on — its change points, or its last status.  A
  busy job spreads over as many tasks as it has open slices;
* ``transformWithState`` per job stitches the slices in time order.  Its state is
  one row per job on the RocksDB store, expired by event-time timers.

Outputs:

* ``change_feed``: a record whenever status/active/succeeded/failed/completion
  changes, one more with ``monitoring = false`` at a terminal state, and nothing
  after the retention;
* ``status_changes`` and ``TotalsSink``: -1 for a job's old status and +1 for its
  new one, and their running sums;
* ``missing_feed``: jobs that a poll which was answered no longer has;
* ``latest_states``: an update-mode aggregation, upserted by key range.

A slice is closed when the watermark passes its end.  An observation with the
empty job name is a heartbeat: it moves the watermark and is in no feed.  Rows that
arrive later than ``watermark`` are dropped by Spark.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from railyard.operators.jobs import DIFF_FIELDS, RETENTION_SECONDS, TERMINAL, classify
from railyard.sources.ranged import RangedTable
from railyard.sources.stored import _fs

OBSERVATION_SCHEMA = T.StructType([
    T.StructField("job_name", T.StringType()),
    T.StructField("namespace", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("event_id", T.LongType()),
    T.StructField("active", T.IntegerType()),
    T.StructField("succeeded", T.IntegerType()),
    T.StructField("failed", T.IntegerType()),
    T.StructField("creation_ts", T.TimestampType()),
    T.StructField("start_ts", T.TimestampType()),
    T.StructField("completion_ts", T.TimestampType()),
    T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
])

# one poll of one job: was it answered?
POLL_SCHEMA = T.StructType([
    T.StructField("job_name", T.StringType()),
    T.StructField("period", T.TimestampType()),
    T.StructField("answered", T.BooleanType()),
])

# name of no job.  It is not NULL: joins drop rows with NULL keys at the scan, before they move a watermark
HEARTBEAT = ""

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

SLICE = "1 minute"
# event time for which a forgotten job's name stays ignored
TOMBSTONE_SECONDS = 24 * 3600


def streaming_session(spark: SparkSession, partitions: int | None = None) -> SparkSession:
    """A session of the same application with the state store that these feeds need; the caller's stays as it is.

    ``partitions`` fixes the number of state partitions, which a checkpoint keeps for good.
    """
    s = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold"):
        s.conf.set(name, spark.conf.get(name))
    s.conf.set("spark.sql.session.timeZone", "UTC")
    s.conf.set(STATE_STORE, ROCKSDB)
    if partitions:
        s.conf.set("spark.sql.shuffle.partitions", str(partitions))
    return s


def read_snapshots(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """File-source stream of observation snapshots (Parquet), with a fixed schema."""
    r = spark.readStream.schema(OBSERVATION_SCHEMA).option("recursiveFileLookup", "true")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(folder)


def _behind_watermark(time: str, condition: Column) -> Column:
    """``condition`` as one comparison that also names the event time, so that the optimizer can neither split it
    nor push it below the watermark, which would keep heartbeats from moving it."""
    row = lambda keep: F.struct(keep.alias("keep"), F.col(time).alias("time"))
    return row(F.coalesce(condition, F.lit(False))).eqNullSafe(row(F.lit(True)))


def _watched(observations: DataFrame, watermark: str) -> DataFrame:
    """Classified observations under a watermark, heartbeats dropped after they have moved it."""
    c = classify(observations.withWatermark("ts", watermark))
    return c.filter(_behind_watermark("ts", F.col("job_name") != HEARTBEAT))


# ---------------------------------------------------------------------------
# change feed
# ---------------------------------------------------------------------------
FEED_SCHEMA = T.StructType([
    T.StructField("job_name", T.StringType()),
    T.StructField("event_id", T.LongType()),
    T.StructField("ts_us", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("active", T.IntegerType()),
    T.StructField("succeeded", T.IntegerType()),
    T.StructField("failed", T.IntegerType()),
    T.StructField("completion_us", T.LongType()),
    T.StructField("monitoring", T.BooleanType()),
])


def change_points(observations: DataFrame, slice: str = SLICE, watermark: str = "1 minute") -> DataFrame:
    """Per (job, closed slice) the observations that a monitor's state can depend on.

    That is a slice's first two rows (they are compared with the slice before),
    every row that differs from the one before it, and the row after such a one
    (an unchanged terminal state ends the monitoring that a change began).  Any
    other row repeats a state that was already repeated.
    """
    c = _watched(observations, watermark)
    state = F.struct("status", "active", "succeeded", "failed", F.unix_micros("completion_ts").alias("completion_us"))
    rows = F.array_sort(F.collect_list(F.struct(F.unix_micros("ts").alias("ts_us"), "event_id", state.alias("state"))))
    sliced = c.groupBy("job_name", F.window("ts", slice)).agg(rows.alias("rows"))

    def changed(i: Column) -> Column:
        return ~F.get("rows", i)["state"].eqNullSafe(F.get("rows", i - 1)["state"])

    kept = F.filter("rows", lambda _, i: (i < 2) | changed(i) | changed(i - 1))
    points = sliced.select("job_name", F.window_time("window").alias("at"), F.explode(kept).alias("p"))
    return points.select("job_name", "at", "p.ts_us", "p.event_id", "p.state.*")


_Record = Row(*FEED_SCHEMA.names)


class _Monitor(StatefulProcessor):
    """What is reported of one job; see ``change_feed``."""

    # one value, as every call to the store is a round trip; of a job whose retention is over only ``gone_us`` is set
    STATE = "status string, active int, succeeded int, failed int, completion_us long, monitoring boolean, remove_at_us long, gone_us long"

    def __init__(self, retention_s: int, tombstone_s: int):
        self.retention_us, self.tombstone_us = retention_s * 1_000_000, tombstone_s * 1_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", self.STATE)

    def handleInputRows(self, key, rows, timerValues):
        st = self.job.get()
        if st and st[7] is not None:
            return
        points = sorted(rows, key=lambda r: (r.ts_us, r.event_id))
        fields, monitoring, remove_at = (tuple(st[:5]), st[5], st[6]) if st else (None, True, None)
        for r in points:
            if remove_at is not None and r.ts_us > remove_at:
                break
            new = (r.status, r.active, r.succeeded, r.failed, r.completion_us)
            changed, was_monitoring = new != fields, monitoring
            if changed:
                fields = new
                yield _Record(key[0], r.event_id, r.ts_us, *new, True)
            if new[0] in TERMINAL and was_monitoring:
                monitoring = False
                yield _Record(key[0], r.event_id, r.ts_us, *new, False)
                if remove_at is None:
                    remove_at = r.ts_us + self.retention_us
                    self.handle.registerTimer(remove_at // 1000 + 1)
            elif changed:
                monitoring = True
        now = (*fields, monitoring, remove_at, None)
        if st is None or now != tuple(st):
            self.job.update(now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        st = self.job.get()
        if st and st[7] is None:
            # the retention is over: only the name stays, so that what comes later does not start it anew
            until = st[6] + self.tombstone_us
            self.job.update((None,) * 7 + (until,))
            self.handle.registerTimer(until // 1000 + 1)
        else:
            self.job.clear()
        return iter(())

    def close(self) -> None:
        pass


def change_feed(observations: DataFrame, retention_s: int = RETENTION_SECONDS, watermark: str = "1 minute",
                slice: str = SLICE, tombstone_s: int = TOMBSTONE_SECONDS) -> DataFrame:
    """Streaming DataFrame of emitted job records; see module doc.

    State is one row per job that is monitored and one per job that ended less
    than ``tombstone_s`` seconds of event time ago; a job of the same name that
    shows up after that starts anew.  ``observations`` must come from a session
    with the RocksDB state store (``streaming_session``).
    """
    points = change_points(observations, slice, watermark)
    fed = points.groupBy("job_name").transformWithState(
        _Monitor(retention_s, tombstone_s), FEED_SCHEMA, "append", "eventtime")
    return fed.select("job_name", "event_id", F.timestamp_micros("ts_us").alias("ts"), "status", "active",
                      "succeeded", "failed", F.timestamp_micros("completion_us").alias("completion_ts"),
                      "monitoring")


# ---------------------------------------------------------------------------
# running totals
# ---------------------------------------------------------------------------
_Change = Row("status", "change")


class _Retract(StatefulProcessor):
    """A job's status moves from the old one to the new one."""

    def init(self, handle) -> None:
        self.known = handle.getValueState("known", "status string")

    def handleInputRows(self, key, rows, timerValues):
        last = max(rows, key=lambda r: r.ts_us).status
        if self.known.exists():
            old = self.known.get()[0]
            if old == last:
                return
            yield _Change(old, -1)
        self.known.update((last,))
        yield _Change(last, 1)

    def close(self) -> None:
        pass


def status_changes(observations: DataFrame, slice: str = SLICE, watermark: str = "1 minute") -> DataFrame:
    """``status, change``: -1 for the status a job leaves, +1 for the one it enters.

    The sum over any run of triggers is the number of jobs in each status.
    """
    c = _watched(observations, watermark)
    last = F.max_by(F.struct(F.unix_micros("ts").alias("ts_us"), "status"), F.struct("ts", "event_id"))
    sliced = c.groupBy("job_name", F.window("ts", slice)).agg(last.alias("s"))
    sliced = sliced.select("job_name", F.window_time("window").alias("at"), "s.ts_us", "s.status")
    return sliced.groupBy("job_name").transformWithState(
        _Retract(), T.StructType.fromDDL("status string, change long"), "append", "eventtime")


class TotalsSink:
    """``foreachBatch`` sink: jobs per status after every trigger.

    Two slots take turns: a trigger adds its changes to the slot of the trigger
    before and overwrites the other one, so a replayed trigger counts once and a
    few rows are all that is ever stored.
    """

    SCHEMA = "status string, n long, batch long"

    def __init__(self, root: str):
        self.slots = [f"{root}/slot-{i}" for i in range(2)]

    def _slot(self, spark: SparkSession, before: int | None = None) -> DataFrame | None:
        held = {}
        for path in self.slots:
            p, fs = _fs(spark, f"{path}/_SUCCESS")
            if fs.exists(p):
                rows = spark.read.schema(self.SCHEMA).parquet(path)
                batch = rows.agg(F.max("batch")).first()[0]
                if batch is not None and (before is None or batch < before):
                    held[batch] = rows
        return held[max(held)] if held else None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        sums = batch.groupBy("status").agg(F.sum("change").alias("n"))
        known = self._slot(spark, batch_id)
        if known is not None:
            sums = sums.unionByName(known.select("status", "n")).groupBy("status").agg(F.sum("n").alias("n"))
        # a row of no status keeps the batch number of a trigger without changes
        mark = spark.createDataFrame([(None, 0)], "status string, n long")
        out = sums.unionByName(mark).groupBy("status").agg(F.sum("n").alias("n")).withColumn("batch", F.lit(batch_id).cast("long"))
        out.coalesce(1).write.mode("overwrite").parquet(self.slots[batch_id % 2])

    def current(self, spark: SparkSession) -> DataFrame:
        """``status, n`` after the last trigger."""
        known = self._slot(spark)
        if known is None:
            return spark.createDataFrame([], "status string, n long")
        return known.filter("n <> 0").select("status", "n")


# ---------------------------------------------------------------------------
# jobs that disappear
# ---------------------------------------------------------------------------
MISSING_SCHEMA = T.StructType([
    T.StructField("job_name", T.StringType()),
    T.StructField("missing_at_us", T.LongType()),
    T.StructField("event_id", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("monitoring", T.BooleanType()),
])


_Missing = Row(*MISSING_SCHEMA.names)


class _Gap(StatefulProcessor):
    """First answered poll of a job that had no observation, while the job is monitored.

    Rows are closed periods, so a trigger brings all that are due and none is older than those of the trigger before.
    """

    def __init__(self, tombstone_s: int):
        self.tombstone_ms = tombstone_s * 1000

    def init(self, handle) -> None:
        self.handle = handle
        # the last record, or the time until which a job that is no longer watched stays ignored
        self.job = handle.getValueState("job", "event_id long, status string, until_ms long")

    def handleInputRows(self, key, rows, timerValues):
        before = st = self.job.get()
        for r in sorted(rows, key=lambda r: r.at_us):
            at_ms = r.at_us // 1000
            if st and st[2] is not None:
                if at_ms <= st[2]:
                    continue
                st = None
            if r.seen:
                st = (r.event_id, r.status, None)
            elif st:
                yield _Missing(key[0], r.at_us, st[0], st[1], False)
            if r.ended or (st and not r.seen):
                # a job that has ended, or was reported, is no longer watched
                st = (None, None, at_ms + self.tombstone_ms)
        if st and st != before:
            self.job.update(st)
            if st[2] is not None:
                self.handle.registerTimer(st[2])
        elif before and not st:
            self.job.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        st = self.job.get()
        if st and st[2] == expiredTimerInfo.getExpiryTimeInMs():
            self.job.clear()
        return iter(())

    def close(self) -> None:
        pass


def missing_feed(polls: DataFrame, observations: DataFrame, period: str = "1 hour", watermark: str = "1 minute",
                 tombstone_s: int = TOMBSTONE_SECONDS) -> DataFrame:
    """Jobs that stop appearing, against the polls that were made (``POLL_SCHEMA``, one per job and period).

    A job is reported once, with its last record and ``monitoring = false``, at
    the first answered poll after its first observation in whose period it was
    not observed.  A poll that failed says nothing, and neither does a period
    in which the job was not polled.  A job that has reached a terminal status
    is no longer monitored; its name is ignored for ``tombstone_s`` seconds more.  Polls and the observations of a period meet in one
    watermarked aggregation; the last period is settled when the watermark of
    both sides has passed it.  A job's state is one row, however many polls it has.
    """
    polls = polls.withWatermark("period", watermark).filter(_behind_watermark("period", (F.col("job_name") != HEARTBEAT) & F.col("answered")))
    polls = polls.select("job_name", F.col("period").alias("ts"), F.lit(True).alias("polled"), F.lit(None).cast("long").alias("event_id"),
                         F.lit(None).cast("string").alias("status"))
    seen = _watched(observations, watermark).select("job_name", "ts", F.lit(False).alias("polled"), "event_id", "status")
    sighted = ~F.col("polled")
    last = F.max_by(F.struct("event_id", "status"), F.when(sighted, F.struct("ts", "event_id")))
    met = polls.unionByName(seen).groupBy("job_name", F.window("ts", period)).agg(
        F.bool_or("polled").alias("polled"), F.bool_or(sighted).alias("seen"), last.alias("s"),
        F.coalesce(F.bool_or(sighted & F.col("status").isin(*TERMINAL)), F.lit(False)).alias("ended"))
    met = met.filter("polled").select("job_name", F.window_time("window").alias("at"), "seen", "s.event_id", "s.status", "ended")
    met = met.withColumn("at_us", F.unix_micros("at"))
    out = met.groupBy("job_name").transformWithState(_Gap(tombstone_s), MISSING_SCHEMA, "append", "eventtime")
    start = F.window(F.timestamp_micros("missing_at_us"), period)["start"]
    return out.select("job_name", start.alias("missing_at"), "event_id", "status", "monitoring")


# ---------------------------------------------------------------------------
# latest states and sinks
# ---------------------------------------------------------------------------
def latest_states(observations: DataFrame) -> DataFrame:
    """Latest classified state of every job, for ``update`` mode: a trigger emits the jobs it changed.

    ``max_by`` keeps one row per job and is aggregated before the shuffle, so a
    busy job costs one row per task; rows may come in any order and late.
    """
    c = classify(observations).filter(F.col("job_name") != HEARTBEAT)
    rest = [x for x in c.columns if x not in ("job_name", "labels")]
    return c.groupBy("job_name").agg(F.max_by(F.struct(*rest), F.struct("ts", "event_id")).alias("s")).select("job_name", "s.*")


class LatestStateWriter:
    """``foreachBatch`` sink keeping the last row per job in a table of key ranges.

    A trigger rewrites the ranges of the jobs it changed and nothing else; of a
    job's rows the one with the greatest ``(ts, event_id)`` stays, at a tie the
    one that ends the monitoring.
    """

    def __init__(self, root: str, ranges: int = 64):
        self.root, self.ranges = root, ranges

    def _table(self, spark: SparkSession, schema: T.StructType) -> RangedTable:
        return RangedTable(spark, self.root, schema, "job_name", self.ranges)

    def __call__(self, batch: DataFrame, batch_id: int) -> list[int]:
        order = [F.col("ts"), F.col("event_id")]
        if "monitoring" in batch.columns:
            order.append(~F.col("monitoring"))
        return self._table(batch.sparkSession, batch.schema).upsert(batch, F.struct(*order), batch_id)

    def current(self, spark: SparkSession) -> DataFrame | None:
        path, fs = _fs(spark, f"{self.root}/rows")
        return spark.read.parquet(f"{self.root}/rows").drop("_range") if fs.exists(path) else None


def append_sink(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Append-only record log (pod records / audit rows) with exactly-once file output."""
    w = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start(path)


class FeedSink:
    """``foreachBatch`` sink for the change feed: the batch's records go to
    ``{root}/records/batch={id}`` (overwrite, so a replayed batch rewrites the
    same folder) and are merged into the latest-state table ``{root}/latest``."""

    def __init__(self, root: str):
        self.root = root
        self.latest = LatestStateWriter(f"{root}/latest")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()     # both writes read it; the stateful step runs once
        try:
            batch.write.mode("overwrite").parquet(f"{self.root}/records/batch={batch_id:012d}")
            self.latest(batch, batch_id)
        finally:
            batch.unpersist()


def start_change_feed(spark: SparkSession, snapshots: str, out_root: str, checkpoint: str,
                      poll_seconds: int = 2, available_now: bool = False,
                      max_files_per_trigger: int | None = None):
    """Run the change feed over a folder of snapshot files.

    Polls every ``poll_seconds`` (the monitor's period), or processes what is
    there and stops with ``available_now``.  Restartable from ``checkpoint``.
    """
    feed = change_feed(read_snapshots(streaming_session(spark), snapshots, max_files_per_trigger))
    w = feed.writeStream.foreachBatch(FeedSink(out_root)).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=f"{poll_seconds} seconds")
    return w.start()


def heartbeat(spark: SparkSession, at: dt.datetime) -> DataFrame:
    """One observation without a job, which closes the slices before ``at`` less the watermark."""
    row = {f.name: None for f in OBSERVATION_SCHEMA.fields} | {"job_name": HEARTBEAT, "ts": at}
    return spark.createDataFrame([tuple(row.values())], OBSERVATION_SCHEMA)
