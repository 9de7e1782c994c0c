"""Hand-computed facts about the sample data set (the reference's seeder)."""

import datetime as dt

from pyspark.sql import functions as F

from railyard.operators import quality as DQ
from railyard.plans import report as R
from railyard.plans.window import Window


def test_row_counts(seed):
    expected = dict(users=10, passengers=10, stations=8, routes=3, trains=5, carriages=20, seats=400,
                    fares=4, trips=5, bookings=20, tickets=20, payments=20, seat_reservations=20)
    for t, n in expected.items():
        assert seed[t].count() == n, t


def test_booking_status_split(seed):
    c = {r["status"]: r["n"] for r in seed["bookings"].groupBy("status").agg(F.count("*").alias("n")).collect()}
    assert c == {"pending": 4, "confirmed": 16}


def test_report_over_load_day(seed):
    rep = R.ticket_report(seed, Window(dt.date(2024, 5, 10), dt.date(2024, 5, 10)))
    rows = rep.collect()
    assert len(rows) == 20
    assert sum(r["paid_amount"] for r in rows) == 2900
    assert sum(r["booking_total_amount"] for r in rows) == 2900
    assert sum(r["ticket_price"] for r in rows) == 1550
    st = [r["latest_payment_status"] for r in rows]
    assert st.count("completed") == 16 and st.count("pending") == 4
    # ordered by service_date, departure_time, ticket_ref
    keys = [(r["service_date"], r["departure_time"], r["ticket_ref"]) for r in rows]
    assert keys == sorted(keys)
    assert rep.columns == R.REPORT_COLUMNS


def test_report_outside_window_is_empty(seed):
    assert R.ticket_report(seed, Window(dt.date(2024, 5, 11), dt.date(2024, 6, 1))).count() == 0


def test_seat_train_mismatch(seed):
    assert DQ.seat_train_mismatch(seed).count() == 16


def test_stations_without_region(seed):
    assert seed["stations"].filter(F.col("region").isNull()).count() == 8
