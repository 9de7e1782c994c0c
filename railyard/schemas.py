"""Domain model as data: table schemas, enum domains, keys, references, defaults.

Everything the data-quality rules, write-path transforms and readers need is
declared here once, so rules are generated from the model rather than written
per table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference model: enum domains, in
# declaration order.  The order matters: MAX over an enum and sorting by an
# enum follow this order, not the alphabet.
# ---------------------------------------------------------------------------
ENUMS: dict[str, list[str]] = {
    "ticket_status": ["reserved", "issued", "checked_in", "cancelled", "refunded"],
    "booking_status": ["pending", "confirmed", "cancelled", "failed"],
    "payment_status": ["pending", "completed", "failed", "refunded"],
    "seat_class": ["economy", "standard", "first", "business"],
    "carriage_type": ["coach", "sleeper", "dining", "cargo"],
    "doc_type": ["id_card", "passport", "other"],
    "fare_refund_policy": ["non_refundable", "partially_refundable", "fully_refundable"],
}

S, L, I, B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()
TS, D = T.TimestampType(), T.DateType()


def dec(p: int, s: int) -> T.DecimalType:
    return T.DecimalType(p, s)


@dataclass(frozen=True)
class Col:
    name: str
    dtype: T.DataType
    nullable: bool = True
    enum: str | None = None        # name in ENUMS
    default: object = None         # column default applied by the write path
    char_len: int | None = None    # char(n) columns


def _c(name, dtype, nullable=True, **kw) -> Col:
    return Col(name, dtype, nullable, **kw)


NOW = "now"  # marker: default is the batch timestamp

# Keys are surrogate identifiers (uuid in the source model).  They are declared
# as strings; the test-data adapter produces integer keys, which every operator
# here accepts as well.
TABLES: dict[str, list[Col]] = {
    "users": [
        _c("id", S, False), _c("email", S, False), _c("password_hash", S), _c("full_name", S),
        _c("phone", S), _c("locale", S), _c("created_at", TS, False, default=NOW),
        _c("updated_at", TS, False, default=NOW),
    ],
    "passengers": [
        _c("id", S, False), _c("user_id", S), _c("first_name", S, False), _c("last_name", S, False),
        _c("date_of_birth", D), _c("doc_type", S, enum="doc_type"), _c("doc_number", S),
        _c("created_at", TS, False, default=NOW),
    ],
    "stations": [
        _c("id", S, False), _c("code", S), _c("name", S, False), _c("city", S), _c("region", S),
        _c("country", S), _c("latitude", dec(9, 6)), _c("longitude", dec(9, 6)), _c("timezone", S),
        _c("created_at", TS, False, default=NOW),
    ],
    "routes": [
        _c("id", S, False), _c("code", S), _c("name", S), _c("notes", S),
        _c("created_at", TS, False, default=NOW),
    ],
    "route_stops": [
        _c("id", S, False), _c("route_id", S, False), _c("station_id", S, False),
        _c("stop_sequence", I, False), _c("scheduled_arrival", T.DayTimeIntervalType()),
        _c("scheduled_departure", T.DayTimeIntervalType()), _c("dwell_seconds", I),
    ],
    "trains": [
        _c("id", S, False), _c("registration", S), _c("model", S), _c("operator", S),
        _c("capacity", I), _c("created_at", TS, False, default=NOW),
    ],
    "carriages": [
        _c("id", S, False), _c("train_id", S, False), _c("carriage_number", I, False),
        _c("carriage_type", S, False, enum="carriage_type", default="coach"), _c("capacity", I),
        _c("notes", S),
    ],
    "seats": [
        _c("id", S, False), _c("carriage_id", S, False), _c("seat_number", S, False),
        _c("seat_class", S, False, enum="seat_class", default="standard"), _c("position", S),
        _c("is_accessible", B, default=False),
    ],
    "trips": [
        _c("id", S, False), _c("route_id", S, False), _c("train_id", S),
        _c("service_date", D, False), _c("departure_time", S, False), _c("arrival_time", S, False),
        _c("departure_station_id", S, False), _c("arrival_station_id", S, False),
        _c("status", S, False, default="scheduled"), _c("created_at", TS, False, default=NOW),
    ],
    "fares": [
        _c("id", S, False), _c("code", S, False), _c("name", S), _c("description", S),
        _c("price", dec(10, 2), False), _c("currency", S, default="EUR", char_len=3),
        _c("seat_class", S, enum="seat_class"), _c("refundable", B, default=False),
        _c("refund_policy", S, enum="fare_refund_policy", default="non_refundable"),
        _c("valid_from", TS), _c("valid_until", TS), _c("created_at", TS, False, default=NOW),
    ],
    "bookings": [
        _c("id", S, False), _c("user_id", S), _c("booking_ref", S, False),
        _c("status", S, False, enum="booking_status", default="pending"),
        _c("total_amount", dec(12, 2), False, default=0), _c("currency", S, default="EUR", char_len=3),
        _c("created_at", TS, False, default=NOW), _c("expires_at", TS),
    ],
    "payments": [
        _c("id", S, False), _c("booking_id", S, False), _c("amount", dec(12, 2), False),
        _c("currency", S, default="EUR", char_len=3), _c("method", S), _c("provider_reference", S),
        _c("status", S, False, enum="payment_status", default="pending"), _c("paid_at", TS),
        _c("created_at", TS, False, default=NOW),
    ],
    "tickets": [
        _c("id", S, False), _c("booking_id", S), _c("passenger_id", S), _c("trip_id", S, False),
        _c("fare_id", S), _c("seat_id", S), _c("ticket_ref", S, False), _c("price", dec(12, 2), False),
        _c("currency", S, default="EUR", char_len=3),
        _c("status", S, False, enum="ticket_status", default="issued"),
        _c("issued_at", TS, False, default=NOW), _c("cancelled_at", TS), _c("checked_in_at", TS),
        _c("notes", S),
    ],
    "seat_reservations": [
        _c("id", S, False), _c("trip_id", S, False), _c("seat_id", S, False), _c("ticket_id", S),
        _c("reserved_by_booking", S), _c("reserved_at", TS, False, default=NOW),
        _c("reserved_until", TS), _c("status", S, False, default="reserved"),
    ],
    "ticket_refunds": [
        _c("id", S, False), _c("ticket_id", S, False), _c("refunded_amount", dec(12, 2), False),
        _c("currency", S, default="EUR", char_len=3), _c("processed_at", TS, False, default=NOW),
        _c("reason", S),
    ],
    "audit_logs": [
        _c("id", L, False), _c("actor_user_id", S), _c("object_type", S, False), _c("object_id", S),
        _c("action", S, False), _c("payload", S), _c("created_at", TS, False, default=NOW),
    ],
    "pod_records": [
        _c("id", L, False), _c("name", S, False), _c("namespace", S, False), _c("status", S, False),
        _c("created_at", TS, False, default=NOW),
    ],
}

# Uniqueness beyond the primary key ``id`` (which every table has).
UNIQUE: dict[str, list[tuple[str, ...]]] = {
    "users": [("email",)],
    "stations": [("code",)],
    "routes": [("code",)],
    "route_stops": [("route_id", "stop_sequence"), ("route_id", "station_id")],
    "trains": [("registration",)],
    "carriages": [("train_id", "carriage_number")],
    "seats": [("carriage_id", "seat_number")],
    "trips": [("route_id", "service_date")],
    "fares": [("code",)],
    "bookings": [("booking_ref",)],
    "tickets": [("ticket_ref",)],
    "seat_reservations": [("trip_id", "seat_id")],
}

# Partial unique index: (trip_id, seat_id) on tickets where seat_id is not null.
PARTIAL_UNIQUE: list[tuple[str, tuple[str, ...], str]] = [
    ("tickets", ("trip_id", "seat_id"), "seat_id IS NOT NULL"),
]


@dataclass(frozen=True)
class ForeignKey:
    child: str
    column: str
    parent: str
    on_delete: str  # cascade | set_null | restrict


CASCADE, SET_NULL, RESTRICT = "cascade", "set_null", "restrict"

FOREIGN_KEYS: list[ForeignKey] = [
    ForeignKey("passengers", "user_id", "users", SET_NULL),
    ForeignKey("route_stops", "route_id", "routes", CASCADE),
    ForeignKey("route_stops", "station_id", "stations", RESTRICT),
    ForeignKey("carriages", "train_id", "trains", CASCADE),
    ForeignKey("seats", "carriage_id", "carriages", CASCADE),
    ForeignKey("trips", "route_id", "routes", RESTRICT),
    ForeignKey("trips", "train_id", "trains", SET_NULL),
    ForeignKey("trips", "departure_station_id", "stations", RESTRICT),
    ForeignKey("trips", "arrival_station_id", "stations", RESTRICT),
    ForeignKey("bookings", "user_id", "users", SET_NULL),
    ForeignKey("payments", "booking_id", "bookings", CASCADE),
    ForeignKey("tickets", "booking_id", "bookings", SET_NULL),
    ForeignKey("tickets", "passenger_id", "passengers", SET_NULL),
    ForeignKey("tickets", "trip_id", "trips", CASCADE),
    ForeignKey("tickets", "fare_id", "fares", SET_NULL),
    ForeignKey("tickets", "seat_id", "seats", SET_NULL),
    ForeignKey("seat_reservations", "trip_id", "trips", CASCADE),
    ForeignKey("seat_reservations", "seat_id", "seats", CASCADE),
    ForeignKey("seat_reservations", "ticket_id", "tickets", SET_NULL),
    ForeignKey("seat_reservations", "reserved_by_booking", "bookings", SET_NULL),
    ForeignKey("ticket_refunds", "ticket_id", "tickets", CASCADE),
    ForeignKey("audit_logs", "actor_user_id", "users", SET_NULL),
]


def schema(table: str) -> T.StructType:
    return T.StructType([T.StructField(c.name, c.dtype, c.nullable) for c in TABLES[table]])


def columns(table: str) -> list[str]:
    return [c.name for c in TABLES[table]]


def not_null_columns(table: str) -> list[str]:
    return [c.name for c in TABLES[table] if not c.nullable]


def enum_columns(table: str) -> list[Col]:
    return [c for c in TABLES[table] if c.enum]


def decimal_columns(table: str) -> list[Col]:
    return [c for c in TABLES[table] if isinstance(c.dtype, T.DecimalType)]


def defaults(table: str) -> dict[str, object]:
    return {c.name: c.default for c in TABLES[table] if c.default is not None}


def children_of(parent: str) -> list[ForeignKey]:
    return [fk for fk in FOREIGN_KEYS if fk.parent == parent]
