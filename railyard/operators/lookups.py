"""Batch lookups: the repository finders as keyed joins.

A finder answers one key at a time; a Spark job answers a whole keys
DataFrame in one scan of the table.  Keys are joined with ``left_semi`` (the
table rows are returned once however many times a key repeats), and the keys
side is broadcast only when the planner measures it small — a keys set grows
with its caller, so no broadcast is forced here.  A single literal key is a
plain filter, which Parquet min/max statistics can skip on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def find_by(table: DataFrame, keys: DataFrame, on: Sequence[str],
            key_cols: Sequence[str] | None = None, ignore_case: bool = False,
            null_safe: bool = False) -> DataFrame:
    """Rows of ``table`` whose ``on`` columns equal a row of ``keys``.

    ``key_cols`` name the matching columns in ``keys`` (default: same names).
    ``ignore_case`` compares ``lower()`` of both sides (the reference keeps a
    ``lower(email)`` index for exactly this).
    """
    key_cols = list(key_cols or on)
    k = keys.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(key_cols)])
    conds = []
    for i, c in enumerate(on):
        a, b = table[c], k[f"__k{i}"]
        if ignore_case:
            a, b = F.lower(a), F.lower(b)
        conds.append(a.eqNullSafe(b) if null_safe else a == b)
    cond = conds[0]
    for c in conds[1:]:
        cond = cond & c
    return table.join(k, cond, "left_semi")


def find_by_value(table: DataFrame, **values) -> DataFrame:
    """Single-key finder with literal values: a pushed-down filter."""
    cond: Column | None = None
    for c, v in values.items():
        e = F.col(c) == F.lit(v)
        cond = e if cond is None else cond & e
    return table.filter(cond)


def find_between(table: DataFrame, column: str, low, high) -> DataFrame:
    """``findBy<Column>Between`` — inclusive on both ends."""
    return table.filter(F.col(column).between(F.lit(low), F.lit(high)))


def children(child: DataFrame, fk: str, parents: DataFrame, parent_key: str = "id",
             order_by: Sequence[str] | None = None) -> DataFrame:
    """Children of a set of parents (``findBy<Parent>Id[OrderBy<Col>]``).

    With ``order_by`` the result is sorted by (parent key, order columns) — a
    range-partitioned sort, so each parent's children come out contiguous and
    in sequence without any single task holding them all.
    """
    out = find_by(child, parents, [fk], [parent_key])
    if order_by:
        out = out.orderBy(fk, *order_by)
    return out


# The finders declared on the repositories (table, kind, columns).
FINDERS: dict[str, tuple[str, str, tuple[str, ...]]] = {
    "BookingRepository.findByBookingRef": ("bookings", "unique", ("booking_ref",)),
    "FareRepository.findByCode": ("fares", "unique", ("code",)),
    "TicketRepository.findByTicketRef": ("tickets", "unique", ("ticket_ref",)),
    "TrainRepository.findByRegistration": ("trains", "unique", ("registration",)),
    "RouteRepository.findByCodeIgnoreCase": ("routes", "ignore_case", ("code",)),
    "StationRepository.findByCodeIgnoreCase": ("stations", "ignore_case", ("code",)),
    "UserAccountRepository.findByEmailIgnoreCase": ("users", "ignore_case", ("email",)),
    "SeatRepository.findByCarriageIdAndSeatNumber": ("seats", "composite", ("carriage_id", "seat_number")),
    "SeatReservationRepository.findByTripIdAndSeatId": ("seat_reservations", "composite", ("trip_id", "seat_id")),
    "TripRepository.findByRouteIdAndServiceDate": ("trips", "composite", ("route_id", "service_date")),
    "TripRepository.findByServiceDateBetween": ("trips", "between", ("service_date",)),
    "BookingRepository.findByStatus": ("bookings", "equal", ("status",)),
    "PaymentRepository.findByStatus": ("payments", "equal", ("status",)),
    "TicketRepository.findByStatus": ("tickets", "equal", ("status",)),
    "CarriageRepository.findByTrainIdOrderByCarriageNumber": ("carriages", "children", ("train_id", "carriage_number")),
    "RouteStopRepository.findByRouteIdOrderByStopSequence": ("route_stops", "children", ("route_id", "stop_sequence")),
    "PassengerRepository.findByUserId": ("passengers", "children", ("user_id",)),
    "PaymentRepository.findByBookingId": ("payments", "children", ("booking_id",)),
    "SeatRepository.findByCarriageId": ("seats", "children", ("carriage_id",)),
    "SeatReservationRepository.findByTripId": ("seat_reservations", "children", ("trip_id",)),
    "TicketRepository.findByTripId": ("tickets", "children", ("trip_id",)),
    "TicketRefundRepository.findByTicketId": ("ticket_refunds", "children", ("ticket_id",)),
    "AuditLogRepository.findByActorId": ("audit_logs", "children", ("actor_user_id",)),
}


def run_finder(tables, finder: str, keys: DataFrame | None = None, low=None, high=None,
               value=None) -> DataFrame:
    """Run a declared finder against a keys DataFrame (or literal bounds/value)."""
    table, kind, cols = FINDERS[finder]
    df = tables[table]
    if kind in ("unique", "composite"):
        return find_by(df, keys, cols, keys.columns[:len(cols)])
    if kind == "ignore_case":
        return find_by(df, keys, cols, keys.columns[:1], ignore_case=True)
    if kind == "between":
        return find_between(df, cols[0], low, high)
    if kind == "equal":
        return find_by_value(df, **{cols[0]: value})
    if kind == "children":
        return children(df, cols[0], keys, keys.columns[0], order_by=list(cols[1:]) or None)
    raise ValueError(kind)
