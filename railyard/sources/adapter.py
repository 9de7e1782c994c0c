"""Domain tables derived from the shared TPC-H-style test tables.

Every expression here has a twin in the DuckDB oracle (``duck_oracle.py``), so
both engines see the same domain data.  The derivations are set-based column
expressions over whole tables: generators (``explode(sequence)``) instead of
cross joins, and scalar subqueries (``DataFrame.scalar``) for table counts so
nothing passes through the driver.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from railyard.functions.enums import enum_at
from railyard.functions.refs import padded_ref
from railyard.sources.tables import DomainTables, tasks_for

EPOCH = "1990-01-01"          # day 0 of trip service dates
ROUTES = 25                   # trips: route = partkey % 25
TRIP_DAY_SPAN = 100000        # trip id = route * 100000 + day number
LOAD_TS = "2000-01-01 00:00:00"  # created_at of reference data with no natural time
NAMESPACE = "rail-jobs"


def _null(dtype: str) -> Column:
    return F.lit(None).cast(dtype)


def _ts(c: Column) -> Column:
    """Zone-less test timestamps are read as UTC instants (session zone is UTC)."""
    return c.cast("timestamp")


def _job_name() -> Column:
    """One job per user; a tenth of them are no report jobs."""
    kind = F.when(F.col("user_id") % 10 == 3, "data-import-").otherwise("ticketing-report-")
    return F.concat(kind, F.col("user_id").cast("string"))


class StarAdapter(DomainTables):
    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(spark)
        self.sf_dir = sf_dir
        self.resolver: DomainTables = self   # where derived inputs of derived tables come from

    def dep(self, name: str) -> DataFrame:
        """A domain table another derivation builds on (the stored copy, when there is one)."""
        return self.resolver[name]

    def src(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.sf_dir, f"{name}.parquet"))

    def build(self, name):
        return getattr(self, f"_{name}")()

    # -- people -------------------------------------------------------------
    def _users(self):
        c = self.src("customer")
        return c.select(
            F.col("c_custkey").alias("id"),
            F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))),
                     F.lit("@Example.com")).alias("email"),
            _null("string").alias("password_hash"),
            F.col("c_name").alias("full_name"),
            _null("string").alias("phone"),
            _null("string").alias("locale"),
            F.lit(LOAD_TS).cast("timestamp").alias("created_at"),
            F.lit(LOAD_TS).cast("timestamp").alias("updated_at"),
        )

    def _passengers(self):
        c = self.src("customer")
        return c.select(
            F.col("c_custkey").alias("id"),
            F.col("c_custkey").alias("user_id"),
            F.col("c_mktsegment").alias("first_name"),
            F.col("c_name").alias("last_name"),
            _null("date").alias("date_of_birth"),
            enum_at(F.col("c_custkey"), "doc_type").alias("doc_type"),
            _null("string").alias("doc_number"),
            F.lit(LOAD_TS).cast("timestamp").alias("created_at"),
        )

    # -- network ------------------------------------------------------------
    def _stations(self):
        n, r = self.src("nation"), self.src("region")
        return n.join(r, n.n_regionkey == r.r_regionkey, "left").select(
            F.col("n_nationkey").cast("long").alias("id"),
            F.concat(F.lit("ST"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("code"),
            F.col("n_name").alias("name"),
            _null("string").alias("city"),
            F.col("r_name").alias("region"),
            _null("string").alias("country"),
            _null("decimal(9,6)").alias("latitude"),
            _null("decimal(9,6)").alias("longitude"),
            _null("string").alias("timezone"),
            F.lit(LOAD_TS).cast("timestamp").alias("created_at"),
        )

    def _routes(self):
        n = self.src("nation")
        return n.select(
            F.col("n_nationkey").cast("long").alias("id"),
            F.concat(F.lit("ROUTE-"), F.col("n_nationkey").cast("string")).alias("code"),
            F.col("n_name").alias("name"),
            _null("string").alias("notes"),
            F.lit(LOAD_TS).cast("timestamp").alias("created_at"),
        )

    def _route_stops(self):
        r = self.dep("routes").select("id").withColumn("seq", F.explode(F.sequence(F.lit(1), F.lit(5))))
        return r.select(
            (F.col("id") * 5 + F.col("seq")).alias("id"),
            F.col("id").alias("route_id"),
            F.pmod(F.col("id") + F.col("seq"), F.lit(ROUTES)).alias("station_id"),
            F.col("seq").alias("stop_sequence"),
            _null("interval day to second").alias("scheduled_arrival"),
            _null("interval day to second").alias("scheduled_departure"),
            F.lit(120).alias("dwell_seconds"),
        )

    # -- rolling stock --------------------------------------------------------
    def _trains(self):
        s = self.src("supplier")
        return s.select(
            F.col("s_suppkey").alias("id"),
            F.col("s_name").alias("registration"),
            _null("string").alias("model"),
            _null("string").alias("operator"),
            (F.lit(200) + F.pmod(F.col("s_suppkey"), F.lit(5)) * 50).cast("int").alias("capacity"),
            F.lit(LOAD_TS).cast("timestamp").alias("created_at"),
        )

    def _carriages(self):
        s = self.src("supplier").select("s_suppkey").withColumn(
            "n", F.explode(F.sequence(F.lit(1), F.lit(4))))
        return s.select(
            (F.col("s_suppkey") * 4 + F.col("n") - 1).alias("id"),
            F.col("s_suppkey").alias("train_id"),
            F.col("n").alias("carriage_number"),
            F.when(F.col("n") <= 2, "coach").otherwise("sleeper").alias("carriage_type"),
            _null("int").alias("capacity"),
            _null("string").alias("notes"),
        )

    def _seats(self):
        c = self.dep("carriages").select("id").withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(19))))
        return c.select(
            (F.col("id") * 20 + F.col("n")).alias("id"),
            F.col("id").alias("carriage_id"),
            F.concat(F.col("n").cast("string"),
                     F.when(F.col("n") % 2 == 0, "A").otherwise("B")).alias("seat_number"),
            F.when(F.col("n") < 10, "economy").otherwise("standard").alias("seat_class"),
            _null("string").alias("position"),
            _null("boolean").alias("is_accessible"),
        )

    # -- products -----------------------------------------------------------
    def _fares(self):
        p = self.src("part")
        return p.select(
            F.col("p_partkey").alias("id"),
            F.concat(F.lit("FARE-"), F.col("p_partkey").cast("string")).alias("code"),
            F.col("p_name").alias("name"),
            _null("string").alias("description"),
            F.col("p_retailprice").cast("decimal(10,2)").alias("price"),
            _null("string").alias("currency"),
            enum_at(F.col("p_size"), "seat_class").alias("seat_class"),
            _null("boolean").alias("refundable"),
            _null("string").alias("refund_policy"),
            _null("timestamp").alias("valid_from"),
            _null("timestamp").alias("valid_until"),
            F.lit(LOAD_TS).cast("timestamp").alias("created_at"),
        )

    # -- sales --------------------------------------------------------------
    def _bookings(self):
        o = self.src("orders")
        return o.select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("user_id"),
            padded_ref("BKG-", F.col("o_orderkey")).alias("booking_ref"),
            F.when(F.col("o_orderstatus") == "P", "pending")
             .when(F.col("o_orderstatus") == "F", "confirmed")
             .when(F.col("o_orderstatus") == "O", "cancelled").alias("status"),
            F.col("o_totalprice").cast("decimal(12,2)").alias("total_amount"),
            _null("string").alias("currency"),
            _ts(F.col("o_orderdate")).alias("created_at"),
            _null("timestamp").alias("expires_at"),
        )

    def _payments(self):
        li = self.src("lineitem")
        rf, ls = F.col("l_returnflag"), F.col("l_linestatus")
        return li.select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
            F.col("l_orderkey").alias("booking_id"),
            F.col("l_extendedprice").cast("decimal(12,2)").alias("amount"),
            _null("string").alias("currency"),
            _null("string").alias("method"),
            _null("string").alias("provider_reference"),
            F.when(rf == "N", "pending").when(rf == "A", "completed")
             .when((rf == "R") & (ls == "F"), "failed")
             .when((rf == "R") & (ls == "O"), "refunded").alias("status"),
            _null("timestamp").alias("paid_at"),
            _ts(F.col("l_shipdate")).alias("created_at"),
        )

    def _ticket_lines(self, tasks: tuple = ()):
        """One row per (order, line): the pair is not unique in lineitem, so every
        other column is reduced with ``min``.  Few pairs repeat, so the rows are exchanged as they are:
        a partial aggregation would hold a map of nearly all rows of its split."""
        li = self.src("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
        return li.repartition(*tasks, "l_orderkey", "l_linenumber").groupBy("l_orderkey", "l_linenumber").agg(
            F.min("l_partkey").alias("pk"), F.min("l_suppkey").alias("sk"),
            F.min("l_extendedprice").alias("ep"), F.min("l_shipdate").alias("sd"))

    def _tickets(self):
        return self._ticket_columns(self._ticket_lines())

    def narrow(self, name: str):
        """For a table stored in an order: the rows its columns are computed from, with the column of that order,
        the computation, and the number of tasks to exchange them by; None for other tables."""
        if name != "tickets":
            return None
        tasks = tasks_for(self.spark, self.src("lineitem").count())
        lines = self._ticket_lines(tasks).withColumn("issued_at", self._issued_at())
        return lines, self._ticket_columns, tasks

    @staticmethod
    def _issued_at() -> Column:
        return _ts(F.col("sd")) + F.make_dt_interval(hours=(F.col("l_orderkey") % 24).cast("int"))

    def _ticket_columns(self, g: DataFrame, *kept: str) -> DataFrame:
        """The columns of tickets from their lines, and ``kept`` ones of these."""
        nc = self.src("customer").select(F.count(F.lit(1))).scalar()
        ok, ln = F.col("l_orderkey"), F.col("l_linenumber")
        tid = ok * 10 + ln
        return g.select(
            tid.alias("id"),
            F.when(ok % 13 == 0, None).otherwise(ok).alias("booking_id"),
            F.when(ok % 17 == 0, None).otherwise(F.pmod(ok * 7 + ln, nc)).alias("passenger_id"),
            (F.pmod(F.col("pk"), F.lit(ROUTES)) * TRIP_DAY_SPAN
             + F.datediff(F.to_date("sd"), F.lit(EPOCH).cast("date"))).cast("long").alias("trip_id"),
            F.when(ln == 7, None).otherwise(F.col("pk")).alias("fare_id"),
            F.when(ln == 6, None).otherwise((F.col("sk") * 4 + ok % 4) * 20 + ln).alias("seat_id"),
            padded_ref("TKT-", tid).alias("ticket_ref"),
            F.col("ep").cast("decimal(12,2)").alias("price"),
            _null("string").alias("currency"),
            enum_at(tid, "ticket_status").alias("status"),
            self._issued_at().alias("issued_at"),
            _null("timestamp").alias("cancelled_at"),
            _null("timestamp").alias("checked_in_at"),
            _null("string").alias("notes"),
            *kept,
        )

    def _trips(self):
        ns = self.src("supplier").select(F.count(F.lit(1))).scalar()
        t = self.dep("tickets").select(F.col("trip_id").alias("id")).distinct()
        i = F.col("id")
        day = F.pmod(i, F.lit(TRIP_DAY_SPAN))
        return t.select(
            i.alias("id"),
            (i / F.lit(TRIP_DAY_SPAN)).cast("long").alias("route_id"),
            F.when(i % 19 == 0, None).otherwise(F.pmod(i, ns)).alias("train_id"),
            F.date_add(F.lit(EPOCH).cast("date"), day.cast("int")).alias("service_date"),
            F.concat(F.lpad((F.lit(6) + i % 12).cast("string"), 2, "0"), F.lit(":00:00")).alias("departure_time"),
            F.concat(F.lpad((F.lit(10) + i % 12).cast("string"), 2, "0"), F.lit(":30:00")).alias("arrival_time"),
            F.pmod(i, F.lit(ROUTES)).alias("departure_station_id"),
            F.pmod(i + 2, F.lit(ROUTES)).alias("arrival_station_id"),
            F.lit("scheduled").alias("status"),
            F.lit(LOAD_TS).cast("timestamp").alias("created_at"),
        )

    def _seat_reservations(self):
        t = self.dep("tickets").filter(F.col("seat_id").isNotNull())
        return t.select(
            F.col("id"), F.col("trip_id"), F.col("seat_id"),
            F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id")).alias("ticket_id"),
            F.col("booking_id").alias("reserved_by_booking"),
            F.col("issued_at").alias("reserved_at"),
            _null("timestamp").alias("reserved_until"),
            F.lit("reserved").alias("status"),
        )

    def _ticket_refunds(self):
        t = self.dep("tickets").filter(F.col("status") == "refunded")
        return t.select(
            F.col("id"), F.col("id").alias("ticket_id"), F.col("price").alias("refunded_amount"),
            _null("string").alias("currency"), F.col("issued_at").alias("processed_at"),
            _null("string").alias("reason"),
        )

    # -- operations ---------------------------------------------------------
    def _audit_logs(self):
        e = self.src("events")
        return e.select(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("actor_user_id"),
            F.col("event_type").alias("object_type"),
            _null("string").alias("object_id"),
            F.lit("log").alias("action"),
            F.col("props").alias("payload"),
            _ts(F.col("ts")).alias("created_at"),
        )

    def _pod_records(self):
        e = self.src("events")
        et = F.col("event_type")
        return e.select(
            F.col("event_id").alias("id"),
            _job_name().alias("name"),
            F.lit(NAMESPACE).alias("namespace"),
            F.when(et == "purchase", "Succeeded").when(et == "error", "Failed")
             .when(et.isin("view", "click"), "Running").otherwise("Pending").alias("status"),
            _ts(F.col("ts")).alias("created_at"),
        )

    def job_observations(self) -> DataFrame:
        """Job-status snapshots: one observation per event (see ``railyard.operators.jobs``)."""
        e = self.src("events")
        et = F.col("event_type")
        ts = _ts(F.col("ts"))
        return e.select(
            _job_name().alias("job_name"),
            F.lit(NAMESPACE).alias("namespace"),
            ts.alias("ts"),
            F.col("event_id"),
            F.when(et.isin("view", "click"), 1).otherwise(0).alias("active"),
            F.when(et == "purchase", 1).otherwise(0).alias("succeeded"),
            F.when(et == "error", 1).otherwise(0).alias("failed"),
            F.date_trunc("day", ts).alias("creation_ts"),
            F.when(et == "signup", None).otherwise(
                ts - F.make_dt_interval(secs=(F.col("event_id") % 600).cast("decimal(18,6)"))).alias("start_ts"),
            F.when(et == "purchase", ts).alias("completion_ts"),
            F.create_map(F.lit("app"), F.lit("ticketing-report")).alias("labels"),
        )

    def job_polls(self) -> DataFrame:
        """Hourly polls of each job from its first to two hours after its last observation.

        A poll that found the job was answered.  Of the hours without an observation one in three failed and
        one in five was not polled, by rule.
        """
        obs = self.job_observations()
        hour = F.date_trunc("hour", "ts")
        seen = obs.groupBy("job_name").agg(F.min(hour).alias("first"), F.max(hour).alias("last"))
        hours = seen.select("job_name", F.explode(F.expr("sequence(first, last + INTERVAL 2 HOURS, INTERVAL 1 HOUR)")).alias("period"))
        found = obs.select("job_name", hour.alias("period"), F.lit(True).alias("found")).distinct()
        turn = F.unix_timestamp("period") / 3600 + F.length("job_name")
        polls = hours.join(found, ["job_name", "period"], "left")
        return (polls.filter(F.col("found").isNotNull() | (turn % 5 != 0))
                     .select("job_name", "period", (F.col("found").isNotNull() | (turn % 3 != 0)).alias("answered")))
