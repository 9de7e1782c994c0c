"""The whole report where its sides are too large to broadcast: what is exchanged, and rows that repeat or lack keys."""

import datetime as dt
from collections import Counter
from decimal import Decimal

import pyarrow.parquet as pq
import pytest

from railyard.plans.report import monthly_report_backfill, report_windows, ticket_report
from railyard.sources import stored
from railyard.sources.tables import DomainTables, JdbcDomain

BROADCAST, PARTS = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.requireAllClusterKeysForCoPartition"


class Rows(DomainTables):
    def __init__(self, spark, **frames):
        super().__init__(spark)
        self.frames = frames

    def build(self, name):
        return self.frames[name]


@pytest.fixture
def tables(spark):
    """Tickets of which some repeat, share a booking and a fare, or lack references; fares, seats and passengers whose ids
    repeat, in equal and in other rows, and references to ids that are not there."""
    ticket = ("id long, ticket_ref string, status string, price decimal(12,2), currency string, issued_at timestamp, "
              "trip_id long, booking_id long, passenger_id long, fare_id long, seat_id long")
    at = dt.datetime(2024, 1, 30, 12)
    tickets = [(i, f"T{i}", "issued", Decimal(i), None, at + dt.timedelta(days=i), i % 3, None if i % 5 == 0 else i // 4,
                None if i % 7 == 0 else i % 6, None if i % 11 == 0 else i % 4, None if i % 3 == 0 else i % 9) for i in range(60)]
    tickets += [tickets[3], tickets[8], tickets[8], (61, None, None, None, None, None, 1, None, 1, 1, 1)]
    make = spark.createDataFrame
    yield Rows(
        spark, tickets=make(tickets, ticket),
        trips=make([(i, 0, i or None, dt.date(2024, 1, 1), "06:00", "10:00", 0, 1) for i in range(3)],
                   "id long, route_id long, train_id long, service_date date, departure_time string, arrival_time string, "
                   "departure_station_id long, arrival_station_id long"),
        routes=make([(0, "R0")], "id long, code string"), stations=make([(0, "S0"), (1, "S1")], "id long, code string"),
        trains=make([(1, "TR1"), (2, "TR2")], "id long, registration string"),
        bookings=make([(i, f"B{i}", "confirmed", Decimal(10), "EUR") for i in range(12)],
                      "id long, booking_ref string, status string, total_amount decimal(12,2), currency string"),
        payments=make([(i % 9, Decimal(i), "completed") for i in range(30)], "booking_id long, amount decimal(12,2), status string"),
        fares=make([(0, "F0", "economy"), (1, "F1", None), (1, "F1", None), (1, "F1b", "economy"), (2, None, None)],
                   "id long, code string, seat_class string"),
        seats=make([(i, 0 if i % 2 else None, f"{i}A") for i in (0, 1, 2, 4, 4, 5)], "id long, carriage_id long, seat_number string"),
        carriages=make([(0, 1), (0, 2)], "id long, carriage_number int"),
        passengers=make([(i, "A", f"P{i}", "passport") for i in (0, 1, 2, 2, 4)],
                        "id long, first_name string, last_name string, doc_type string"))
    spark.conf.unset(BROADCAST)
    spark.conf.unset(PARTS)


def _rows(df):
    return Counter(map(repr, df.collect()))


def _nodes(plan):
    plan = plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    yield plan
    for i in range(plan.children().size()):
        yield from _nodes(plan.children().apply(i))


def test_large_sides_give_the_rows_that_small_ones_give(spark, tables):
    windows = spark.createDataFrame([("w", dt.date(2024, 2, 1), dt.date(2024, 2, 20)), ("v", dt.date(2024, 2, 10), dt.date(2024, 3, 20))],
                                    "window_id string, start date, end date")
    reports = (lambda: monthly_report_backfill(tables), lambda: ticket_report(tables), lambda: report_windows(tables, windows),
               lambda: ticket_report(tables, columns=["ticket_ref", "booking_ref", "fare_code"]))
    small = [_rows(r()) for r in reports]
    spark.conf.set(BROADCAST, "-1")
    for r, rows in zip(reports, small, strict=True):
        assert "__place" in r()._jdf.queryExecution().analyzed().toString()
        assert _rows(r()) == rows
    assert sum(small[0].values()) > 64   # the repeated ids of sides count


def test_tickets_are_exchanged_once_for_their_large_sides(spark, tables):
    spark.conf.set(BROADCAST, "-1")
    plan = monthly_report_backfill(tables)._jdf.queryExecution().executedPlan()
    exchanged = [n.simpleString(1000) for n in _nodes(plan) if n.nodeName() == "Exchange" and "ticket_status#" in n.output().mkString(" ")]
    # by the place; then for the trip, the route, two stations and the train, which are broadcast at any size seen so far
    assert len(exchanged) == 6 and sum("hashpartitioning(__place" in x for x in exchanged) == 1, exchanged


def test_tables_that_may_change_are_read_once(spark, tables):
    assert not JdbcDomain.rereadable
    spark.conf.set(BROADCAST, "-1")
    tables.rereadable = False
    for t in (tables, tables.with_overrides(tickets=tables["tickets"])):
        assert "__place" not in monthly_report_backfill(t)._jdf.queryExecution().analyzed().toString()


def test_the_largest_stored_tables_are_compressed_further(spark, tables, tmp_path):
    files = {name: tmp_path / name for name in ("tickets", "passengers")}
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, None)
    for name, path in files.items():
        stored.write_table(tables[name], name, str(path))
    assert spark.conf.get(clean, None) == before
    footers = {name: [pq.ParquetFile(f).metadata for f in path.rglob("*.parquet")] for name, path in files.items()}
    codec = {name: {f.row_group(0).column(0).compression for f in found if f.num_row_groups} for name, found in footers.items()}
    # files that joins may broadcast keep the compression that their size is judged by
    assert codec["tickets"] == {"ZSTD"} and codec["passengers"] == {"SNAPPY"}
    back = spark.read.parquet(str(files["tickets"]))
    assert _rows(back.select(*tables["tickets"].columns)) == _rows(tables["tickets"])
