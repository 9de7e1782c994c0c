"""The ticket-level report: tickets enriched with trip, route, stations,
booking, payment summary, passenger, fare, seat, carriage and train.

Join semantics follow the reference query exactly:
  * trip, route and both stations are INNER (a ticket without them is dropped);
  * booking, passenger, fare, seat, carriage, train and payments are LEFT;
  * carriage is reached through the seat, train through the trip;
  * the payment summary joins on the *booking's* id, so it is NULL whenever
    the booking is missing even if the ticket carries a booking id.

Plan shape (what Catalyst/AQE are steered to):
  * the date window is a filter on ``tickets.issued_at`` — pushed to the scan
    as a half-open timestamp range, below every join; on stored tickets
    (partitioned by ``issue_month``) the matching month folders are the only
    ones listed and read;
  * no broadcast is forced: stations and routes, and whatever else proves
    small, are broadcast by their measured size;
  * payments are aggregated per booking (partial aggregation before the
    shuffle) and joined to bookings on the same key, so the aggregate's
    output partitioning is reused and the pair costs one shuffle of bookings;
  * with a window, payments, bookings, passengers and trips are first
    semi-joined to the window's keys, so a one-month report carries only their
    rows of that month into the aggregation and the wide joins;
  * a side above ``spark.sql.autoBroadcastJoinThreshold`` stays a shuffle join,
    and AQE splits its skewed partitions;
  * the five nullable references (booking, passenger, fare, seat, train) are
    left-joined with NULL keys spread over many partitions
    (``left_join_spread_nulls``), so tickets without a booking or seat do not
    all meet in one task;
  * without a window, fares, seats and passengers too large to broadcast are
    looked up by (booking, key) pairs (``_looked_up``) and the answers meet the
    tickets where these meet their bookings, so that the wide rows of a ticket
    are exchanged once and not once per side.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railyard.functions.enums import enum_max
from railyard.operators.joins import spread_key
from railyard.plans.window import Window, in_window
from railyard.sources.tables import DomainTables, tasks_for

# The report's 25 output columns, in their order.
REPORT_COLUMNS = [
    "ticket_ref", "ticket_status", "ticket_price", "ticket_currency", "issued_at",
    "booking_ref", "booking_status", "booking_total_amount", "booking_currency",
    "paid_amount", "latest_payment_status",
    "passenger_first_name", "passenger_last_name", "passenger_doc_type",
    "service_date", "departure_time", "arrival_time",
    "departure_station_code", "arrival_station_code", "route_code",
    "fare_code", "fare_seat_class", "seat_number", "carriage_number", "train_registration",
]

REPORT_ORDER = ["service_date", "departure_time", "ticket_ref"]


def payment_summary(payments: DataFrame) -> DataFrame:
    """Per booking: sum of all payment amounts (any status/currency) and the
    greatest payment status by enum declaration order."""
    return payments.groupBy("booking_id").agg(
        F.sum("amount").alias("paid_amount"),
        enum_max("status", "payment_status").alias("latest_payment_status"),
    )


def booking_payments(bookings: DataFrame, payments: DataFrame) -> DataFrame:
    """Bookings with their payment summary (LEFT: no payment → NULL, not 0).

    Both sides are keyed by booking id; the aggregate is already hash
    partitioned on it, so the join adds only the bookings shuffle.
    """
    b = bookings.select(
        F.col("id").alias("b_id"), "booking_ref",
        F.col("status").alias("booking_status"),
        F.col("total_amount").alias("booking_total_amount"),
        F.col("currency").alias("booking_currency"))
    pay = payment_summary(payments)
    return b.join(pay, b.b_id == pay.booking_id, "left").drop("booking_id")


def window_tickets(tables: DomainTables, window: Window | None) -> DataFrame:
    """Tickets issued in ``window`` (inclusive dates in the session zone); all if None."""
    t = tables["tickets"]
    if window is not None:
        t = t.filter(in_window(F.col("issued_at"), window))
        if "issue_month" in t.columns:
            # stored tickets are partitioned by issue month: prune whole folders.  The folder's
            # month was taken in the writing session's zone, so a day on either side is read too
            day = dt.timedelta(days=1)
            t = t.filter(F.col("issue_month").between((window.start - day).strftime("%Y-%m"),
                                                      (window.end + day).strftime("%Y-%m")))
    return t


# Which left-joined dimension each report column comes from (the rest come from
# the ticket or the inner-joined trip, route and stations).
_LEFT_SOURCES = {
    "bk": ["booking_ref", "booking_status", "booking_total_amount", "booking_currency",
           "paid_amount", "latest_payment_status"],
    "ps": ["passenger_first_name", "passenger_last_name", "passenger_doc_type"],
    "fa": ["fare_code", "fare_seat_class"],
    "st": ["seat_number", "carriage_number"],
    "tn": ["train_registration"],
}


def _exceeds_broadcast(df: DataFrame) -> bool:
    """Whether Spark's estimate of ``df`` is above the session's broadcast threshold, so that a join exchanges both sides."""
    most = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > most


def _looked_up(t: DataFrame, column: str, right: DataFrame, key: str, tag: str, tasks: int) -> DataFrame:
    """What ``right`` has for the tickets' ``column``: its columns once for each pair (place, key) that tickets
    ask for, dealt by the place.

    The pairs alone are exchanged by the key, and the answers by the place.  ``right`` may repeat a key, even in equal
    rows: those become one with their number, so that a pair's answers are distinct however many tickets ask.
    """
    asked = t.select(F.col("__place").alias(f"__at_{tag}"), F.col(column).alias(f"__key_{tag}")).filter(F.col(f"__key_{tag}").isNotNull())
    rows = right.repartition(tasks, *right.columns).groupBy(*right.columns).agg(F.count(F.lit(1)).alias(f"__n_{tag}"))
    found = asked.join(rows, asked[f"__key_{tag}"] == rows[key]).drop(key)
    return found.repartition(tasks, f"__at_{tag}").distinct()


def ticket_report(tables: DomainTables, window: Window | None = None, ordered: bool = True,
                  strip_zone: bool = True, columns: list[str] | None = None) -> DataFrame:
    """The 25-column report for tickets issued in ``window`` (all tickets if None).

    ``strip_zone`` casts ``issued_at`` to a zone-less timestamp, as the export does.
    ``columns`` selects a subset of the report columns; left joins that feed none
    of them are not built at all (they join on primary keys, so they never change
    the row count — Spark cannot know that, so it would not drop them itself).
    The inner joins always stay: they decide which tickets are reported.
    """
    wanted = list(columns or REPORT_COLUMNS)
    unknown = set(wanted) - set(REPORT_COLUMNS)
    if unknown:
        raise ValueError(f"not report columns: {sorted(unknown)}")
    need = {tag for tag, cols in _LEFT_SOURCES.items() if set(cols) & set(wanted)}
    t = window_tickets(tables, window)
    # tickets of a bucketed domain bring their booking's columns along
    brought = [c for c in _LEFT_SOURCES["bk"] if c in t.columns]
    if brought:
        need.discard("bk")
    t = t.select(
        "ticket_ref", F.col("status").alias("ticket_status"), F.col("price").alias("ticket_price"),
        F.col("currency").alias("ticket_currency"), "issued_at", "trip_id", "booking_id", "passenger_id", "fare_id", "seat_id", *brought)
    bookings, payments = tables["bookings"], tables["payments"]

    def of_window(side, key, column):
        """Rows of ``side`` that a ticket of the window refers to by ``column``."""
        if window is None:
            return side
        keys = t.select(F.col(column).alias("__w")).filter(F.col("__w").isNotNull()).distinct()
        return side.join(keys, side[key] == keys["__w"], "left_semi")

    trips = of_window(tables["trips"], "id", "trip_id").select(
        F.col("id").alias("tr_id"), F.col("route_id").alias("tr_route_id"),
        F.col("train_id").alias("tr_train_id"), "service_date", "departure_time", "arrival_time",
        F.col("departure_station_id").alias("tr_dep"), F.col("arrival_station_id").alias("tr_arr"))
    routes = tables["routes"].select(F.col("id").alias("ro_id"), F.col("code").alias("route_code"))
    stations = tables["stations"].select("id", "code")
    dep = stations.select(F.col("id").alias("dep_id"), F.col("code").alias("departure_station_code"))
    arr = stations.select(F.col("id").alias("arr_id"), F.col("code").alias("arrival_station_code"))

    pas = of_window(tables["passengers"], "id", "passenger_id").select(
        F.col("id").alias("p_id"), F.col("first_name").alias("passenger_first_name"),
        F.col("last_name").alias("passenger_last_name"),
        F.col("doc_type").cast("string").alias("passenger_doc_type"), F.lit(False).alias("__r_ps"))
    fares = tables["fares"].select(
        F.col("id").alias("f_id"), F.col("code").alias("fare_code"),
        F.col("seat_class").cast("string").alias("fare_seat_class"), F.lit(False).alias("__r_fa"))
    seats = tables["seats"].select(F.col("id").alias("s_id"), F.col("carriage_id").alias("s_carriage_id"),
                                   "seat_number")
    carriages = tables["carriages"].select(F.col("id").alias("c_id"), "carriage_number")
    trains = tables["trains"].select(F.col("id").alias("tn_id"), F.col("registration").alias("train_registration"),
                                     F.lit(False).alias("__r_tn"))

    # seat → carriage first (a snowflake hop on a nullable key)
    seat_car = (seats.join(carriages, seats.s_carriage_id == carriages.c_id, "left")
                .select("s_id", "seat_number", "carriage_number", F.lit(False).alias("__r_st")))

    def on(j, column, tag, right, key):
        # (is-NULL flag, key-or-salt), formed at the join, so that no exchange carries more than the key itself
        nk, jk = spread_key(F.col(column), F.col("ticket_ref"), j.schema[column].dataType)
        return (nk == right[f"__r_{tag}"]) & (jk == right[key])

    sides = [(column, tag, right, key, size) for column, tag, right, key, size in
             [("fare_id", "fa", fares, "f_id", fares), ("seat_id", "st", seat_car, "s_id", seats), ("passenger_id", "ps", pas, "p_id", pas)]
             if tag in need]
    by_pairs = window is None and tables.rereadable and "bk" in need and _exceeds_broadcast(bookings)
    looked_up = [x for x in sides if by_pairs and _exceeds_broadcast(x[4])]
    j = t
    if looked_up:
        # the answers meet the tickets by (place, key), of which both are dealt by the place alone
        t.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        # a task sorts its tickets once for each side, so it should hold a third of the rows of other tasks
        more = tasks_for(tables.spark, 3 * tables["tickets"].count())
        tasks = more[0] if more else int(tables.spark.conf.get("spark.sql.shuffle.partitions"))
        no_booking, place = spread_key(F.col("booking_id"), F.col("ticket_ref"), t.schema["booking_id"].dataType)
        j = t.select(*[c for c in t.columns if c != "booking_id"], no_booking.alias("__no_booking"), place.alias("__place"))
        if more:
            bookings, payments = bookings.repartition(tasks, "id"), payments.repartition(tasks, "booking_id")
    # sides that are broadcast come first, before a ticket is exchanged; of others, those that bring most columns last:
    # a ticket is exchanged for each of them, and should not carry yet what the small sides (trips and beyond) bring
    for column, tag, right, key, _ in [x for x in sides if x not in looked_up]:
        j = j.join(right, on(j, column, tag, right, key), "left")
    if "bk" in need:
        bp = booking_payments(of_window(bookings, "id", "booking_id"),
                              of_window(payments, "booking_id", "booking_id")).withColumn("__r_bk", F.lit(False))
    if looked_up:
        asking = j
        j = j.repartition(tasks, "__place")
        for column, tag, right, key, _ in looked_up:
            found = _looked_up(asking, column, right.drop(f"__r_{tag}"), key, tag, tasks)
            j = j.join(found, (j["__place"] == found[f"__at_{tag}"]) & (j[column] == found[f"__key_{tag}"]), "left")
        j = j.join(bp, (j["__place"] == bp.b_id) & ~j["__no_booking"], "left")
        # equal rows of a side count one by one
        n = reduce(lambda a, b: a * b, [F.coalesce(F.col(f"__n_{x[1]}"), F.lit(1)) for x in looked_up])
        j = j.select("*", F.explode(F.array_repeat(F.lit(0), n.cast("int"))))
    elif "bk" in need:
        j = j.join(bp, on(j, "booking_id", "bk", bp, "b_id"), "left")
    j = (j.join(trips, F.col("trip_id") == trips.tr_id, "inner")
          .join(routes, F.col("tr_route_id") == routes.ro_id, "inner")
          .join(dep, F.col("tr_dep") == dep.dep_id, "inner")
          .join(arr, F.col("tr_arr") == arr.arr_id, "inner"))
    if "tn" in need:
        j = j.join(trains, on(j, "tr_train_id", "tn", trains, "tn_id"), "left")

    cols = [F.col(c).cast("timestamp_ntz").alias(c) if (c == "issued_at" and strip_zone) else F.col(c)
            for c in wanted]
    if ordered:
        # order by the report keys even when they are not among the selected columns
        return j.orderBy(*REPORT_ORDER).select(*cols)
    return j.select(*cols)


def monthly_report_backfill(tables: DomainTables, ordered: bool = False) -> DataFrame:
    """All months in one job: the report for every ticket, tagged with its
    calendar month (``report_month`` = first day of the issue month).

    Monthly windows do not overlap, so the period of a ticket is a column
    expression — no periods table, no range join — and ``report_month`` is the
    partition key when the result is written (one directory per month).
    """
    t_month = F.trunc(F.to_date("issued_at"), "MM")
    base = ticket_report(tables, None, ordered=False, strip_zone=False)
    # issued_at is still zone-aware here: the month comes from the session-zone date
    out = base.select(t_month.alias("report_month"),
                      *[F.col(c) if c != "issued_at" else F.col(c).cast("timestamp_ntz").alias(c)
                        for c in REPORT_COLUMNS])
    if ordered:
        out = out.orderBy("report_month", *REPORT_ORDER)
    return out


def report_windows(tables: DomainTables, windows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The report of many windows at once: its rows once per window (``window_id``) that they fall into.

    ``windows`` has ``window_id, start, end`` (dates, inclusive); they may overlap
    and be of any length.  Tickets meet the windows' days in an equi-join, so no
    window is compared with a ticket of another day; the report itself is built
    once for the tickets of all windows, from one scan of tickets.
    """
    wrong = windows.filter(F.col("start").isNull() | F.col("end").isNull() | (F.col("start") > F.col("end"))).limit(1).collect()
    if wrong:
        raise ValueError(f"window {wrong[0].window_id!r} has no days: {wrong[0].start} to {wrong[0].end}")
    days = windows.select("window_id", F.explode(F.sequence("start", "end")).alias("__day"), F.col("start").alias("__from"), F.col("end").alias("__to"))
    span = windows.agg(F.min("start"), F.max("end")).first()
    t = tables["tickets"]
    if span[0] is None:
        t = t.filter("false")
    else:
        t = window_tickets(tables, Window(*span))
    t = t.join(days.select("__day").distinct(), F.to_date("issued_at") == F.col("__day"), "left_semi")
    wanted = list(columns or REPORT_COLUMNS)
    base = ticket_report(tables.with_overrides(tickets=t), None, ordered=False, strip_zone=False,
                         columns=wanted + [c for c in ("issued_at",) if c not in wanted])
    issued = F.to_date("issued_at")
    met = base.join(days, (issued == F.col("__day")) & issued.between(F.col("__from"), F.col("__to")))
    return met.select("window_id", *[F.col(c).cast("timestamp_ntz").alias(c) if c == "issued_at" else F.col(c) for c in wanted])
