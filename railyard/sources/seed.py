"""The small sample data set (the reference's seeder), generated set-wise.

Loops with modular assignment become ``spark.range(n)`` plus column
expressions, and the "pick the i-th parent" assignments become computed
keys.  Random references and ``now()`` are replaced by deterministic values
(``BKG-%08d``/``TKT-%08d`` and an explicit ``as_of``).  Used as a test
fixture with hand-checkable results.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railyard.functions.refs import padded, padded_ref
from railyard.sources.tables import DomainTables

# Fixed values of the sample data set.
STATION_CODES = ["ROM", "MIL", "VEN", "FLO", "NAP", "TUR", "BOL", "GEN"]
STATION_CITIES = ["Rome", "Milan", "Venice", "Florence", "Naples", "Turin", "Bologna", "Genoa"]
FARE_CODES = ["ECON-STD", "ECON-FLEX", "FIRST-PRM", "BUS-FLEX"]
FARE_CLASSES = ["economy", "economy", "first", "business"]
FARE_PRICES = ["29.99", "49.99", "99.99", "149.99"]
N_USERS, N_ROUTES, N_TRAINS, CARRIAGES_PER_TRAIN, SEATS_PER_CARRIAGE = 10, 3, 5, 4, 20
N_TRIPS, N_BOOKINGS = 5, 20


def _pick(values: list[str], idx) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


class SeedTables(DomainTables):
    def __init__(self, spark: SparkSession, as_of: dt.datetime):
        super().__init__(spark)
        self.as_of = as_of

    def build(self, name):
        return getattr(self, f"_{name}")()

    def _r(self, n: int) -> DataFrame:
        return self.spark.range(n).withColumnRenamed("id", "i")

    def _ts(self):
        return F.lit(self.as_of).cast("timestamp")

    def _users(self):
        i = F.col("i") + 1
        return self._r(N_USERS).select(
            i.alias("id"), F.concat(F.lit("user"), i.cast("string"), F.lit("@example.org")).alias("email"),
            *[F.lit(None).cast("string").alias(c) for c in ("password_hash", "full_name", "phone", "locale")],
            self._ts().alias("created_at"), self._ts().alias("updated_at"))

    def _passengers(self):
        i = F.col("i")
        return self._r(N_USERS).select(
            (i + 1).alias("id"), (i + 1).alias("user_id"),
            (i + 1).cast("string").alias("first_name"), (i + 1).cast("string").alias("last_name"),
            F.lit(None).cast("date").alias("date_of_birth"),
            F.lit("passport").alias("doc_type"), padded_ref("PASS", i + 1, 6).alias("doc_number"),
            self._ts().alias("created_at"))

    def _stations(self):
        i = F.col("i")
        return self._r(len(STATION_CODES)).select(
            i.alias("id"), _pick(STATION_CODES, i).alias("code"),
            F.concat(_pick(STATION_CITIES, i), F.lit(" Central")).alias("name"),
            _pick(STATION_CITIES, i).alias("city"), F.lit(None).cast("string").alias("region"),
            F.lit("Italy").alias("country"), (F.lit(40) + i).cast("decimal(9,6)").alias("latitude"),
            (F.lit(10) + i).cast("decimal(9,6)").alias("longitude"), F.lit("Europe/Rome").alias("timezone"),
            self._ts().alias("created_at"))

    def _routes(self):
        i = F.col("i")
        return self._r(N_ROUTES).select(
            i.alias("id"), F.concat(F.lit("ROUTE-"), (i + 1).cast("string")).alias("code"),
            F.concat(F.lit("Express Route "), (i + 1).cast("string")).alias("name"),
            F.lit("High-speed service").alias("notes"), self._ts().alias("created_at"))

    def _route_stops(self):
        return self.spark.createDataFrame([], "id long, route_id long, station_id long, stop_sequence int")

    def _trains(self):
        i = F.col("i")
        return self._r(N_TRAINS).select(
            i.alias("id"), F.concat(F.lit("TRAIN-"), (i + 1).cast("string")).alias("registration"),
            F.concat(F.lit("Model-X"), (i + 1).cast("string")).alias("model"),
            F.lit("Rail Operator").alias("operator"), (F.lit(250) + i * 50).cast("int").alias("capacity"),
            self._ts().alias("created_at"))

    def _carriages(self):
        i = F.col("i")
        n = i % CARRIAGES_PER_TRAIN + 1
        return self._r(N_TRAINS * CARRIAGES_PER_TRAIN).select(
            i.alias("id"), (i / CARRIAGES_PER_TRAIN).cast("long").alias("train_id"),
            n.cast("int").alias("carriage_number"),
            F.when(n <= 2, "coach").otherwise("sleeper").alias("carriage_type"),
            F.lit(50).alias("capacity"), F.lit(None).cast("string").alias("notes"))

    def _seats(self):
        i = F.col("i")
        s = i % SEATS_PER_CARRIAGE + 1
        return self._r(N_TRAINS * CARRIAGES_PER_TRAIN * SEATS_PER_CARRIAGE).select(
            i.alias("id"), (i / SEATS_PER_CARRIAGE).cast("long").alias("carriage_id"),
            F.concat(s.cast("string"), F.when(s % 2 == 0, "A").otherwise("B")).alias("seat_number"),
            F.when(s <= 10, "economy").otherwise("standard").alias("seat_class"),
            F.when(s % 2 == 0, "window").otherwise("aisle").alias("position"),
            (s == 1).alias("is_accessible"))

    def _fares(self):
        i = F.col("i")
        return self._r(len(FARE_CODES)).select(
            i.alias("id"), _pick(FARE_CODES, i).alias("code"),
            F.concat(F.lit("Fare "), _pick(FARE_CODES, i)).alias("name"),
            F.concat(F.lit("Travel with "), _pick(FARE_CLASSES, i)).alias("description"),
            _pick(FARE_PRICES, i).cast("decimal(10,2)").alias("price"), F.lit("EUR").alias("currency"),
            _pick(FARE_CLASSES, i).alias("seat_class"), (i % 2 == 1).alias("refundable"),
            F.when(i % 2 == 1, "fully_refundable").otherwise("non_refundable").alias("refund_policy"),
            F.lit(None).cast("timestamp").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_until"),
            self._ts().alias("created_at"))

    def _trips(self):
        i = F.col("i")
        return self._r(N_TRIPS).select(
            i.alias("id"), (i % N_ROUTES).alias("route_id"), (i % N_TRAINS).alias("train_id"),
            F.date_add(F.lit(self.as_of.date()), i.cast("int")).alias("service_date"),
            F.concat(padded(F.lit(8) + i, 2), F.lit(":00:00")).alias("departure_time"),
            F.concat(padded(F.lit(12) + i, 2), F.lit(":30:00")).alias("arrival_time"),
            (i % len(STATION_CODES)).alias("departure_station_id"),
            ((i + 2) % len(STATION_CODES)).alias("arrival_station_id"),
            F.lit("scheduled").alias("status"), self._ts().alias("created_at"))

    def _bookings(self):
        i = F.col("i")
        confirmed = i % 5 != 0
        return self._r(N_BOOKINGS).select(
            i.alias("id"), (i % N_USERS + 1).alias("user_id"), padded_ref("BKG-", i).alias("booking_ref"),
            F.when(confirmed, "confirmed").otherwise("pending").alias("status"),
            (F.lit(50) + i * 10).cast("decimal(12,2)").alias("total_amount"), F.lit("EUR").alias("currency"),
            self._ts().alias("created_at"),
            (self._ts() + F.make_dt_interval(days=F.lit(7))).alias("expires_at"))

    def _payments(self):
        b = self["bookings"]
        return b.select(
            F.col("id"), F.col("id").alias("booking_id"), F.col("total_amount").alias("amount"),
            F.lit("EUR").alias("currency"), F.lit("card").alias("method"),
            F.lit(None).cast("string").alias("provider_reference"),
            F.when(F.col("status") == "confirmed", "completed").otherwise("pending").alias("status"),
            F.when(F.col("status") == "confirmed", self._ts()).alias("paid_at"),
            self._ts().alias("created_at"))

    def _tickets(self):
        b = self["bookings"].select(F.col("id").alias("i"), F.col("status").alias("bstatus"))
        i = F.col("i")
        return b.select(
            i.alias("id"), i.alias("booking_id"), (i % N_USERS + 1).alias("passenger_id"),
            (i % N_TRIPS).alias("trip_id"), (i % len(FARE_CODES)).alias("fare_id"),
            (i % (N_TRAINS * CARRIAGES_PER_TRAIN * SEATS_PER_CARRIAGE)).alias("seat_id"),
            padded_ref("TKT-", i).alias("ticket_ref"), (F.lit(30) + i * 5).cast("decimal(12,2)").alias("price"),
            F.lit("EUR").alias("currency"),
            F.when(F.col("bstatus") == "confirmed", "issued").otherwise("reserved").alias("status"),
            self._ts().alias("issued_at"), F.lit(None).cast("timestamp").alias("cancelled_at"),
            F.lit(None).cast("timestamp").alias("checked_in_at"), F.lit(None).cast("string").alias("notes"))

    def _seat_reservations(self):
        t = self["tickets"]
        return t.select(
            "id", "trip_id", "seat_id", F.lit(None).cast("long").alias("ticket_id"),
            F.col("booking_id").alias("reserved_by_booking"), self._ts().alias("reserved_at"),
            (self._ts() + F.make_dt_interval(hours=F.lit(2))).alias("reserved_until"),
            F.lit("reserved").alias("status"))

    def _ticket_refunds(self):
        return self.spark.createDataFrame([], "id long, ticket_id long, refunded_amount decimal(12,2)")

    def _audit_logs(self):
        return self.spark.createDataFrame([], "id long, actor_user_id long, object_type string, action string")

    def _pod_records(self):
        return self.spark.createDataFrame([], "id long, name string, namespace string, status string")
