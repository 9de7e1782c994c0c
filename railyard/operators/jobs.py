"""Job-status observations → classified states, change feed, latest states.

An observation is one poll of one job: ``(job_name, ts, event_id, active,
succeeded, failed, creation_ts, start_ts, completion_ts, labels)``.  These
are the batch forms; ``railyard.streaming.job_feed`` runs the same logic
incrementally over arriving snapshot files.

Skew: one job may own a large share of all observations.  Nothing here
gathers a job's history in one task: the per-job "previous observation" is
found inside (job, time bucket) partitions and stitched across bucket
borders with a small per-bucket summary, and latest-state queries are
``max_by`` aggregations (map-side partial aggregation).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from railyard.functions.timefmt import duration_seconds, duration_text, iso_utc

# Job states, in precedence order, and the job-name prefix.
SUCCEEDED, FAILED, RUNNING, PENDING = "Succeeded", "Failed", "Running", "Pending"
TERMINAL = (SUCCEEDED, FAILED)
JOB_PREFIX = "ticketing-report"
RETENTION_SECONDS = 30

# fields whose change is reported (compared NULL-safely)
DIFF_FIELDS = ["status", "active", "succeeded", "failed", "completion_ts"]
ORDER = ["ts", "event_id"]


def classify(obs: DataFrame) -> DataFrame:
    """Status by precedence succeeded > failed > active > pending; counters
    NULL → 0; no status block at all (all three counters NULL) → NULL status."""
    a, s, f = (F.coalesce(F.col(c), F.lit(0)) for c in ("active", "succeeded", "failed"))
    no_block = F.col("active").isNull() & F.col("succeeded").isNull() & F.col("failed").isNull()
    status = (F.when(no_block, F.lit(None).cast("string"))
              .when(s > 0, SUCCEEDED).when(f > 0, FAILED).when(a > 0, RUNNING).otherwise(PENDING))
    return obs.select(
        *[c for c in obs.columns if c not in ("active", "succeeded", "failed")],
        F.when(no_block, None).otherwise(a).alias("active"),
        F.when(no_block, None).otherwise(s).alias("succeeded"),
        F.when(no_block, None).otherwise(f).alias("failed"),
        status.alias("status"))


def _differs(prev: Column, fields: list[str]) -> Column:
    cond = prev.isNull()
    for c in fields:
        cond = cond | ~F.col(c).eqNullSafe(prev[c])
    return cond


def changes(obs: DataFrame, bucket: str = "day") -> DataFrame:
    """Observations that differ from the job's previous observation in any of
    status/active/succeeded/failed/completion_ts; a job's first observation
    always counts (registration stores a state no poll can equal)."""
    return with_change_flag(obs, bucket).filter("changed").drop("changed")


def with_change_flag(obs: DataFrame, bucket: str = "day") -> DataFrame:
    """Every classified observation with ``changed`` (see ``changes``).

    ``bucket`` bounds the work per task: the previous observation is looked
    up within (job, bucket) and, for a bucket's first row, taken from the
    last row of the job's preceding non-empty bucket.
    """
    c = classify(obs).withColumn("__bkt", F.date_trunc(bucket, "ts"))
    state = F.struct(*[F.col(x) for x in DIFF_FIELDS])
    last = (c.groupBy("job_name", "__bkt")
             .agg(F.max_by(state, F.struct(*ORDER)).alias("__last")))
    carry = last.select("job_name", "__bkt", F.lag("__last").over(
        W.partitionBy("job_name").orderBy("__bkt")).alias("__carry"))
    w = W.partitionBy("job_name", "__bkt").orderBy(*ORDER)
    j = c.withColumn("__lag", F.lag(state).over(w)).join(carry, ["job_name", "__bkt"], "left")
    prev = F.coalesce(F.col("__lag"), F.col("__carry"))
    return j.withColumn("changed", _differs(prev, DIFF_FIELDS)).drop("__bkt", "__lag", "__carry")


def terminal_feed(obs: DataFrame, retention_s: int = RETENTION_SECONDS, bucket: str = "day") -> DataFrame:
    """The records a monitor emits for each job, with its retention rule:

    * every change (``monitoring = true``) while the job is monitored;
    * at the job's first terminal observation (Succeeded/Failed) one more
      record of that state with ``monitoring = false``; the job is forgotten
      ``retention_s`` seconds after it and later observations are ignored;
    * inside that retention window the monitor re-arms: after a change, the
      next terminal observation emits another ``monitoring = false`` record.

    Inside the window an observation either sets the monitor (a change that is
    not terminal), resets it (terminal, unchanged), flips it (a terminal
    change) or leaves it; so its state before an observation is that of the
    last set or reset, flipped as often as flips came since — running window
    sums over seconds of history per job.  The flagged observations are built
    once; a row gives none, one or two records.
    """
    terminal = F.coalesce(F.col("status").isin(*TERMINAL), F.lit(False))
    pos = F.struct("ts", "event_id")
    t0 = classify(obs).filter(terminal).groupBy("job_name").agg(F.min(pos).alias("__t0"))
    f = with_change_flag(obs, bucket).join(t0, "job_name", "left")
    until = F.col("__t0.ts") + F.make_dt_interval(secs=F.lit(retention_s))
    inside = F.coalesce((pos > F.col("__t0")) & (F.col("ts") <= until), F.lit(False))
    # only rows of the retention window look at each other; all others are dealt by time, so a job's history spreads
    f = f.withColumn("__in", inside).withColumn("__part", F.when(~F.col("__in"), F.date_trunc(bucket, "ts")))
    order = W.partitionBy("job_name", "__in", "__part").orderBy(*ORDER)
    flip = (terminal & F.col("changed")).cast("int")
    held = F.when(terminal != F.col("changed"), F.struct((~terminal).cast("int").alias("on"), F.col("__flips").alias("flips")))
    f = (f.withColumn("__flips", F.sum(flip).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
          .withColumn("__held", F.last(held, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))))
    armed = (F.coalesce(F.col("__held.on"), F.lit(0)) + F.col("__flips") - flip - F.coalesce(F.col("__held.flips"), F.lit(0))) % 2 == 1
    emitted = F.when(F.col("changed") & (F.col("__t0").isNull() | (F.col("ts") <= until)), True)
    final = F.when((pos == F.col("__t0")) | (F.col("__in") & terminal & armed), False)
    records = F.explode(F.array_compact(F.array(emitted, final)))
    return f.withColumn("monitoring", records).drop("__t0", "__in", "__part", "__flips", "__held", "changed")


def latest(obs: DataFrame) -> DataFrame:
    """Latest classified state per job (the dashboard's job map)."""
    c = classify(obs)
    cols = [x for x in c.columns if x != "job_name"]
    return (c.groupBy("job_name").agg(F.max_by(F.struct(*cols), F.struct(*ORDER)).alias("__s"))
             .select("job_name", "__s.*"))


def status_counts(states: DataFrame) -> DataFrame:
    """Running / succeeded / failed totals (pending jobs are in none)."""
    return states.agg(
        F.count(F.lit(1)).alias("n_jobs"),
        F.count_if(F.col("status") == RUNNING).alias("running"),
        F.count_if(F.col("status") == SUCCEEDED).alias("succeeded"),
        F.count_if(F.col("status") == FAILED).alias("failed"))


def newest_first(states: DataFrame) -> DataFrame:
    return states.orderBy(F.col("creation_ts").desc(), F.col("job_name"))


def with_durations(states: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Duration in seconds (to completion, or to ``as_of`` while running; 0
    without a start), its display text, and ISO-8601 UTC timestamp text."""
    secs = duration_seconds(F.col("start_ts"), F.col("completion_ts"), F.lit(as_of).cast("timestamp"))
    return states.select(
        "job_name", "status",
        secs.alias("duration_seconds"), duration_text(secs).alias("duration_text"),
        iso_utc(F.col("creation_ts")).alias("creation_timestamp"),
        iso_utc(F.col("start_ts")).alias("start_time"),
        iso_utc(F.col("completion_ts")).alias("completion_time"))


def with_period_labels(states: DataFrame) -> DataFrame:
    """Report period from the job's ``start-date``/``end-date`` labels (NULL when absent)."""
    lab = F.col("labels")
    return states.withColumn("start_date", F.try_element_at(lab, F.lit("start-date"))) \
                 .withColumn("end_date", F.try_element_at(lab, F.lit("end-date")))


def prefix_filter(df: DataFrame, column: str, prefix: str = JOB_PREFIX) -> DataFrame:
    return df.filter(F.col(column).startswith(prefix))


def missing_jobs(obs: DataFrame, period: str = "hour") -> DataFrame:
    """Monitored jobs that a later snapshot no longer has (the 404 case): the
    job's last record before its first gap, once, with ``monitoring = false``
    and the snapshot in which it was missed.

    Snapshots are the ``period``-wide intervals in which anything was polled;
    the last one has no successor and misses nothing.  A job that has reached
    a terminal status is no longer monitored and is not missed.
    """
    c = classify(obs).withColumn("__snap", F.date_trunc(period, "ts"))
    cols = DIFF_FIELDS + ["ts", "event_id"]
    last = (c.groupBy("job_name", "__snap")
             .agg(F.max_by(F.struct(*cols), F.struct(*ORDER)).alias("__s")))
    done = (c.filter(F.col("status").isin(*TERMINAL))
             .groupBy("job_name").agg(F.min("__snap").alias("__done")))
    # one row per polled interval
    polls = c.select("__snap").distinct()
    polls = polls.select("__snap", F.lead("__snap").over(W.orderBy("__snap")).alias("__next"))
    seen = last.select(F.col("job_name").alias("__j"), F.col("__snap").alias("__n"))
    watched = (last.join(polls.filter(F.col("__next").isNotNull()), "__snap").join(done, "job_name", "left")
                   .filter(F.col("__done").isNull() | (F.col("__done") > F.col("__snap"))))
    gone = watched.join(seen, (F.col("job_name") == F.col("__j")) & (F.col("__next") == F.col("__n")), "left_anti")
    first = gone.groupBy("job_name").agg(F.min_by(F.struct(F.col("__next").alias("missing_at"), "__s"), "__snap").alias("__f"))
    return first.select("job_name", F.col("__f.missing_at").alias("missing_at"), "__f.__s.*", F.lit(False).alias("monitoring"))


def preferred_pod(pods: DataFrame, group: str = "name", phase: str = "status",
                  order: str = "id") -> DataFrame:
    """Per group, the first pod in Running or Succeeded phase, else the first pod.

    A ``min_by`` aggregation on (preference, order): partial aggregation on
    the map side, so a group with many pods is never gathered in one place.
    """
    pref = F.when(F.col(phase).isin(RUNNING, SUCCEEDED), 0).otherwise(1)
    cols = [c for c in pods.columns if c != group]
    return (pods.groupBy(group).agg(F.min_by(F.struct(*cols), F.struct(pref, F.col(order))).alias("__p"))
                .select(group, "__p.*"))
