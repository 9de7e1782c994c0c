"""DuckDB twin of the test-data adapter, used to build the oracle SQL.

``with_domain(sql)`` prefixes a query with CTEs that derive the domain tables
from the shared test tables with the same expressions as
``railyard.sources.adapter.StarAdapter``.  Written independently in DuckDB's
dialect so the oracle does not share code with the Spark plans.
"""

from __future__ import annotations

import re

DOMAIN_CTES: dict[str, str] = {
    "users": """
        SELECT c_custkey AS id,
               lower(replace(c_name, '#', '.')) || '@Example.com' AS email,
               CAST(NULL AS VARCHAR) AS password_hash, c_name AS full_name,
               CAST(NULL AS VARCHAR) AS phone, CAST(NULL AS VARCHAR) AS locale,
               TIMESTAMP '2000-01-01 00:00:00' AS created_at,
               TIMESTAMP '2000-01-01 00:00:00' AS updated_at
        FROM customer""",
    "passengers": """
        SELECT c_custkey AS id, c_custkey AS user_id, c_mktsegment AS first_name,
               c_name AS last_name, CAST(NULL AS DATE) AS date_of_birth,
               (['id_card', 'passport', 'other'])[c_custkey % 3 + 1] AS doc_type,
               CAST(NULL AS VARCHAR) AS doc_number,
               TIMESTAMP '2000-01-01 00:00:00' AS created_at
        FROM customer""",
    "stations": """
        SELECT CAST(n_nationkey AS BIGINT) AS id, 'ST' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS code,
               n_name AS name, CAST(NULL AS VARCHAR) AS city, r_name AS region,
               CAST(NULL AS VARCHAR) AS country, CAST(NULL AS DECIMAL(9,6)) AS latitude,
               CAST(NULL AS DECIMAL(9,6)) AS longitude, CAST(NULL AS VARCHAR) AS timezone,
               TIMESTAMP '2000-01-01 00:00:00' AS created_at
        FROM nation LEFT JOIN region ON n_regionkey = r_regionkey""",
    "routes": """
        SELECT CAST(n_nationkey AS BIGINT) AS id, 'ROUTE-' || CAST(n_nationkey AS VARCHAR) AS code,
               n_name AS name, CAST(NULL AS VARCHAR) AS notes,
               TIMESTAMP '2000-01-01 00:00:00' AS created_at
        FROM nation""",
    "route_stops": """
        SELECT r.id * 5 + s.seq AS id, r.id AS route_id, (r.id + s.seq) % 25 AS station_id,
               CAST(s.seq AS INTEGER) AS stop_sequence, 120 AS dwell_seconds
        FROM routes r, (SELECT unnest(range(1, 6)) AS seq) s""",
    "trains": """
        SELECT s_suppkey AS id, s_name AS registration, CAST(NULL AS VARCHAR) AS model,
               CAST(NULL AS VARCHAR) AS operator, CAST(200 + s_suppkey % 5 * 50 AS INTEGER) AS capacity,
               TIMESTAMP '2000-01-01 00:00:00' AS created_at
        FROM supplier""",
    "carriages": """
        SELECT s_suppkey * 4 + n - 1 AS id, s_suppkey AS train_id, CAST(n AS INTEGER) AS carriage_number,
               CASE WHEN n <= 2 THEN 'coach' ELSE 'sleeper' END AS carriage_type,
               CAST(NULL AS INTEGER) AS capacity, CAST(NULL AS VARCHAR) AS notes
        FROM supplier, (SELECT unnest(range(1, 5)) AS n) g""",
    "seats": """
        SELECT c.id * 20 + n AS id, c.id AS carriage_id,
               CAST(n AS VARCHAR) || CASE WHEN n % 2 = 0 THEN 'A' ELSE 'B' END AS seat_number,
               CASE WHEN n < 10 THEN 'economy' ELSE 'standard' END AS seat_class,
               CAST(NULL AS VARCHAR) AS position, CAST(NULL AS BOOLEAN) AS is_accessible
        FROM carriages c, (SELECT unnest(range(0, 20)) AS n) g""",
    "fares": """
        SELECT p_partkey AS id, 'FARE-' || CAST(p_partkey AS VARCHAR) AS code, p_name AS name,
               CAST(NULL AS VARCHAR) AS description, CAST(p_retailprice AS DECIMAL(10,2)) AS price,
               CAST(NULL AS VARCHAR) AS currency,
               (['economy', 'standard', 'first', 'business'])[p_size % 4 + 1] AS seat_class,
               CAST(NULL AS BOOLEAN) AS refundable, CAST(NULL AS VARCHAR) AS refund_policy,
               CAST(NULL AS TIMESTAMP) AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_until,
               TIMESTAMP '2000-01-01 00:00:00' AS created_at
        FROM part""",
    "bookings": """
        SELECT o_orderkey AS id, o_custkey AS user_id, printf('BKG-%08d', o_orderkey) AS booking_ref,
               CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'confirmed'
                                  WHEN 'O' THEN 'cancelled' END AS status,
               CAST(o_totalprice AS DECIMAL(12,2)) AS total_amount, CAST(NULL AS VARCHAR) AS currency,
               o_orderdate AS created_at, CAST(NULL AS TIMESTAMP) AS expires_at
        FROM orders""",
    "payments": """
        SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS booking_id,
               CAST(l_extendedprice AS DECIMAL(12,2)) AS amount, CAST(NULL AS VARCHAR) AS currency,
               CAST(NULL AS VARCHAR) AS method, CAST(NULL AS VARCHAR) AS provider_reference,
               CASE WHEN l_returnflag = 'N' THEN 'pending'
                    WHEN l_returnflag = 'A' THEN 'completed'
                    WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'failed'
                    WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'refunded' END AS status,
               CAST(NULL AS TIMESTAMP) AS paid_at, l_shipdate AS created_at
        FROM lineitem""",
    "ticket_lines": """
        SELECT l_orderkey, l_linenumber, min(l_partkey) AS pk, min(l_suppkey) AS sk,
               min(l_extendedprice) AS ep, min(l_shipdate) AS sd
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "tickets": """
        SELECT l_orderkey * 10 + l_linenumber AS id,
               CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_orderkey END AS booking_id,
               CASE WHEN l_orderkey % 17 = 0 THEN NULL
                    ELSE (l_orderkey * 7 + l_linenumber) % (SELECT count(*) FROM customer) END AS passenger_id,
               (pk % 25) * 100000 + date_diff('day', DATE '1990-01-01', CAST(sd AS DATE)) AS trip_id,
               CASE WHEN l_linenumber = 7 THEN NULL ELSE pk END AS fare_id,
               CASE WHEN l_linenumber = 6 THEN NULL ELSE (sk * 4 + l_orderkey % 4) * 20 + l_linenumber END AS seat_id,
               printf('TKT-%08d', l_orderkey * 10 + l_linenumber) AS ticket_ref,
               CAST(ep AS DECIMAL(12,2)) AS price, CAST(NULL AS VARCHAR) AS currency,
               (['reserved', 'issued', 'checked_in', 'cancelled', 'refunded'])[(l_orderkey * 10 + l_linenumber) % 5 + 1] AS status,
               sd + to_hours(CAST(l_orderkey % 24 AS BIGINT)) AS issued_at,
               CAST(NULL AS TIMESTAMP) AS cancelled_at, CAST(NULL AS TIMESTAMP) AS checked_in_at,
               CAST(NULL AS VARCHAR) AS notes
        FROM ticket_lines""",
    "trips": """
        SELECT id, id // 100000 AS route_id,
               CASE WHEN id % 19 = 0 THEN NULL ELSE id % (SELECT count(*) FROM supplier) END AS train_id,
               CAST(DATE '1990-01-01' + CAST(id % 100000 AS INTEGER) AS DATE) AS service_date,
               lpad(CAST(6 + id % 12 AS VARCHAR), 2, '0') || ':00:00' AS departure_time,
               lpad(CAST(10 + id % 12 AS VARCHAR), 2, '0') || ':30:00' AS arrival_time,
               id % 25 AS departure_station_id, (id + 2) % 25 AS arrival_station_id,
               'scheduled' AS status, TIMESTAMP '2000-01-01 00:00:00' AS created_at
        FROM (SELECT DISTINCT trip_id AS id FROM tickets) d""",
    "seat_reservations": """
        SELECT id, trip_id, seat_id, CASE WHEN id % 3 = 0 THEN NULL ELSE id END AS ticket_id,
               booking_id AS reserved_by_booking, issued_at AS reserved_at,
               CAST(NULL AS TIMESTAMP) AS reserved_until, 'reserved' AS status
        FROM tickets WHERE seat_id IS NOT NULL""",
    "ticket_refunds": """
        SELECT id, id AS ticket_id, price AS refunded_amount, CAST(NULL AS VARCHAR) AS currency,
               issued_at AS processed_at, CAST(NULL AS VARCHAR) AS reason
        FROM tickets WHERE status = 'refunded'""",
    "audit_logs": """
        SELECT event_id AS id, user_id AS actor_user_id, event_type AS object_type,
               CAST(NULL AS VARCHAR) AS object_id, 'log' AS action, props AS payload, ts AS created_at
        FROM events""",
    "pod_records": """
        SELECT event_id AS id, CASE WHEN user_id % 10 = 3 THEN 'data-import-' ELSE 'ticketing-report-' END || CAST(user_id AS VARCHAR) AS name,
               'rail-jobs' AS namespace,
               CASE WHEN event_type = 'purchase' THEN 'Succeeded' WHEN event_type = 'error' THEN 'Failed'
                    WHEN event_type IN ('view', 'click') THEN 'Running' ELSE 'Pending' END AS status,
               ts AS created_at
        FROM events""",
    "job_obs": """
        SELECT CASE WHEN user_id % 10 = 3 THEN 'data-import-' ELSE 'ticketing-report-' END || CAST(user_id AS VARCHAR) AS job_name,
               'rail-jobs' AS namespace, ts, event_id,
               CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END AS active,
               CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS succeeded,
               CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS failed,
               date_trunc('day', ts) AS creation_ts,
               CASE WHEN event_type = 'signup' THEN NULL
                    ELSE ts - to_seconds(CAST(event_id % 600 AS BIGINT)) END AS start_ts,
               CASE WHEN event_type = 'purchase' THEN ts END AS completion_ts
        FROM events""",
}

def _large(c: str) -> str:
    return f"CASE WHEN id % 89 = 0 THEN CAST({c} AS DOUBLE) * 1e9 ELSE CAST({c} AS DOUBLE) END AS {c}"


# an unchecked delivery with faults, which the data-quality rules read
DOMAIN_CTES.update({
    "d_tickets": f"""
        SELECT * REPLACE (CASE WHEN id % 101 = 0 THEN NULL ELSE ticket_ref END AS ticket_ref, {_large("price")},
                          CASE WHEN id % 97 = 0 THEN 'void' ELSE status END AS status,
                          CASE WHEN id % 103 = 0 THEN 'EURO' ELSE currency END AS currency) FROM tickets""",
    "d_bookings": f"SELECT * REPLACE ({_large('total_amount')}) FROM bookings WHERE id % 11 <> 0",
    "d_payments": f"SELECT * REPLACE ({_large('amount')}) FROM payments",
    "d_fares": f"SELECT * REPLACE ({_large('price')}) FROM fares",
    "d_ticket_refunds": f"SELECT * REPLACE ({_large('refunded_amount')}) FROM ticket_refunds",
})


def _delivered(table: str) -> str:
    return f"d_{table}" if f"d_{table}" in DOMAIN_CTES else table


# dependencies between the CTEs above (order of definition)
_ORDER = list(DOMAIN_CTES)


def with_domain(sql: str) -> str:
    """Prefix ``sql`` with exactly the domain CTEs it (transitively) references."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in _ORDER:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(DOMAIN_CTES[name])

    visit(sql)
    parts = [f"{n} AS ({DOMAIN_CTES[n]})" for n in _ORDER if n in needed]
    if not parts:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body[len("WITH RECURSIVE "):]
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body


# ---------------------------------------------------------------------------
# Oracle queries (DuckDB dialect), one per registered Spark query.
# ---------------------------------------------------------------------------

_PAYMENT_SUMMARY = """
    SELECT booking_id,
           CAST(sum(amount) AS DECIMAL(22,2)) AS paid_amount,
           (['pending', 'completed', 'failed', 'refunded'])[max(
               CASE status WHEN 'pending' THEN 1 WHEN 'completed' THEN 2
                           WHEN 'failed' THEN 3 WHEN 'refunded' THEN 4 END)] AS latest_payment_status
    FROM payments GROUP BY booking_id"""

# the report's ways from a ticket to other tables: (role, table, from role, by column, must exist)
_WAYS = [
    ("trip", "trips", "ticket", "trip_id", True), ("route", "routes", "trip", "route_id", True),
    ("departure", "stations", "trip", "departure_station_id", True), ("arrival", "stations", "trip", "arrival_station_id", True),
    ("booking", "bookings", "ticket", "booking_id", False), ("passenger", "passengers", "ticket", "passenger_id", False),
    ("fare", "fares", "ticket", "fare_id", False), ("seat", "seats", "ticket", "seat_id", False),
    ("carriage", "carriages", "seat", "carriage_id", False), ("train", "trains", "trip", "train_id", False),
]

# fixed values: output columns per role, in report order where it matters only by name
_SHOWN = {
    "ticket": {"ticket_ref": "ticket_ref", "status": "ticket_status", "price": "ticket_price",
               "currency": "ticket_currency", "issued_at": "issued_at"},
    "booking": {"booking_ref": "booking_ref", "status": "booking_status", "total_amount": "booking_total_amount",
                "currency": "booking_currency"},
    "passenger": {"first_name": "passenger_first_name", "last_name": "passenger_last_name", "doc_type": "passenger_doc_type"},
    "trip": {c: c for c in ("service_date", "departure_time", "arrival_time")},
    "departure": {"code": "departure_station_code"}, "arrival": {"code": "arrival_station_code"},
    "route": {"code": "route_code"}, "fare": {"code": "fare_code", "seat_class": "fare_seat_class"},
    "seat": {"seat_number": "seat_number"}, "carriage": {"carriage_number": "carriage_number"},
    "train": {"registration": "train_registration"},
}


def _report(where: str = "", extra: str = "") -> str:
    shown = [f"{role}.{c} AS {name}" for role, cs in _SHOWN.items() for c, name in cs.items()]
    shown += [f"money.{c} AS {c}" for c in ("paid_amount", "latest_payment_status")]
    steps = " ".join(f"{'INNER' if needed else 'LEFT'} JOIN {table} AS {role} ON {role}.id = {origin}.{column}"
                     for role, table, origin, column, needed in _WAYS)
    return (f"WITH money AS ({_PAYMENT_SUMMARY}) SELECT {extra} {', '.join(shown)} FROM tickets AS ticket {steps} "
            f"LEFT JOIN money ON money.booking_id = booking.id {where}")


def _between(a: str, b: str) -> str:
    return f"WHERE CAST(ticket.issued_at AS DATE) BETWEEN DATE '{a}' AND DATE '{b}'"


ORACLE: dict[str, str] = {
    "ticket_report": _report(),
    "ticket_report_window": _report(_between("1998-01-01", "1998-01-31")),
    # as_of 1998-03-17: month to date, and the previous full month
    "ticket_report_mtd": _report(_between("1998-03-01", "1998-03-17")),
    "ticket_report_prev_month": _report(_between("1998-02-01", "1998-02-28")),
    "monthly_report_backfill": _report(
        extra="CAST(date_trunc('month', ticket.issued_at) AS DATE) AS report_month,"),
    "payment_summary": _PAYMENT_SUMMARY,
}



ORACLE.update({
    "trip_endpoints": """
        SELECT trip.id AS trip_id, trip.service_date, dep.code AS departure_station_code,
               arr.code AS arrival_station_code
        FROM trips trip JOIN stations dep ON dep.id = trip.departure_station_id
                        JOIN stations arr ON arr.id = trip.arrival_station_id""",
    "ticket_left_enrich": """
        SELECT t.ticket_ref, b.booking_ref, p.last_name AS passenger_last_name, f.code AS fare_code,
               s.seat_number
        FROM tickets t LEFT JOIN bookings b ON b.id = t.booking_id
                       LEFT JOIN passengers p ON p.id = t.passenger_id
                       LEFT JOIN fares f ON f.id = t.fare_id
                       LEFT JOIN seats s ON s.id = t.seat_id""",
    "seat_carriage_chain": """
        SELECT t.ticket_ref, s.seat_number, c.carriage_number, c.carriage_type
        FROM tickets t LEFT JOIN seats s ON s.id = t.seat_id
                       LEFT JOIN carriages c ON c.id = s.carriage_id""",
    "booking_payment_status": f"""
        WITH paid AS ({_PAYMENT_SUMMARY})
        SELECT bk.booking_ref, bk.status AS booking_status, paid.paid_amount, paid.latest_payment_status
        FROM bookings bk LEFT JOIN paid ON paid.booking_id = bk.id""",
    "table_profile": """
        SELECT count(*) AS n_tickets, min(issued_at) AS first_issued_at, max(issued_at) AS last_issued_at
        FROM tickets""",
    "lookup_unique": """
        SELECT id, booking_ref, status, total_amount FROM bookings
        WHERE booking_ref IN (SELECT printf('BKG-%08d', booking_id) FROM tickets
                              WHERE status = 'checked_in' AND booking_id IS NOT NULL)""",
    "lookup_ignore_case": """
        SELECT id, email FROM users
        WHERE lower(email) IN (
            SELECT lower(lower(replace(p.last_name, '#', '.')) || '@example.com')
            FROM passengers p
            WHERE p.id IN (SELECT passenger_id FROM tickets
                           WHERE CAST(issued_at AS DATE) BETWEEN DATE '1998-01-01' AND DATE '1998-01-31'))""",
    "lookup_composite": """
        SELECT r.id, r.trip_id, r.seat_id, r.ticket_id FROM seat_reservations r
        WHERE EXISTS (SELECT 1 FROM tickets t
                      WHERE CAST(t.issued_at AS DATE) BETWEEN DATE '1998-01-01' AND DATE '1998-01-31'
                        AND t.seat_id IS NOT NULL AND t.trip_id = r.trip_id AND t.seat_id = r.seat_id)""",
    "trips_between": """
        SELECT id, route_id, service_date FROM trips
        WHERE service_date BETWEEN DATE '1998-01-01' AND DATE '1998-01-31'""",
    "filter_status": "SELECT id, booking_ref FROM bookings WHERE status = 'pending'",
    "children_ordered": """
        SELECT id, train_id, carriage_number FROM carriages
        WHERE train_id IN (SELECT train_id FROM trips
                           WHERE service_date BETWEEN DATE '1998-01-01' AND DATE '1998-01-31')
        ORDER BY train_id, carriage_number""",
    "children_of": """
        SELECT id, user_id, last_name FROM passengers
        WHERE user_id IN (SELECT user_id FROM bookings
                          WHERE CAST(created_at AS DATE) BETWEEN DATE '1998-01-01' AND DATE '1998-01-31')""",
    "dq_seat_train": """
        SELECT t.ticket_ref, c.train_id AS seat_train_id, trip.train_id AS trip_train_id
        FROM tickets t JOIN trips trip ON trip.id = t.trip_id
                       JOIN seats s ON s.id = t.seat_id
                       LEFT JOIN carriages c ON c.id = s.carriage_id
        WHERE c.train_id IS DISTINCT FROM trip.train_id""",
    "dq_partial_unique": """
        SELECT 'tickets' AS table_name, 'trip_id,seat_id' AS key_columns,
               CAST(to_json([CAST(trip_id AS VARCHAR), CAST(seat_id AS VARCHAR)]) AS VARCHAR) AS key_value,
               count(*) AS n_rows
        FROM tickets WHERE seat_id IS NOT NULL AND trip_id IS NOT NULL
        GROUP BY trip_id, seat_id HAVING count(*) > 1""",
    # the declared numeric columns
    "dq_decimal": " UNION ALL ".join(
        f"""SELECT '{t}' AS table_name, '{c}' AS column_name, 'decimal({p},{s})' AS target_type,
                   count({c}) AS n_values,
                   count(*) FILTER (WHERE {c} IS NOT NULL AND TRY_CAST({c} AS DECIMAL({p},{s})) IS NULL) AS n_overflow
            FROM {_delivered(t)}""" for t, c, p, s in [
                ("stations", "latitude", 9, 6), ("stations", "longitude", 9, 6), ("fares", "price", 10, 2),
                ("bookings", "total_amount", 12, 2), ("payments", "amount", 12, 2), ("tickets", "price", 12, 2),
                ("ticket_refunds", "refunded_amount", 12, 2)]),
})


def _dq_sql() -> dict[str, str]:
    """Data-quality oracles, one SELECT per declared constraint (from the model lists)."""
    from railyard import schemas as M

    uniq = []
    for t in M.TABLES:
        for cols in [("id",)] + M.UNIQUE.get(t, []):
            notnull = " AND ".join(f"{c} IS NOT NULL" for c in cols)
            key = ", ".join(f"CAST({c} AS VARCHAR)" for c in cols)
            uniq.append(f"""SELECT '{t}' AS table_name, '{",".join(cols)}' AS key_columns,
                CAST(to_json([{key}]) AS VARCHAR) AS key_value, count(*) AS n_rows
                FROM {t} WHERE {notnull} GROUP BY {", ".join(cols)} HAVING count(*) > 1""")
    refs = []
    for fk in M.FOREIGN_KEYS:
        refs.append(f"""SELECT '{fk.child}' AS table_name, '{fk.column}' AS column_name,
                '{fk.parent}' AS parent_table, count(*) AS n_refs,
                count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM {_delivered(fk.parent)} p WHERE p.id = c.{fk.column})) AS n_orphans
                FROM {_delivered(fk.child)} c WHERE c.{fk.column} IS NOT NULL""")
    nulls, doms = [], []
    for t in M.TABLES:
        for c in M.not_null_columns(t):
            if t == "route_stops" and c.startswith("scheduled_"):
                continue
            nulls.append(f"SELECT '{t}' AS table_name, '{c}' AS column_name, "
                         f"count(*) FILTER (WHERE {c} IS NULL) AS n_null FROM {_delivered(t)}")
        for col in M.TABLES[t]:
            if col.enum:
                dom = ", ".join(f"'{v}'" for v in M.ENUMS[col.enum])
                doms.append(f"SELECT '{t}' AS table_name, '{col.name}' AS column_name, 'enum:{col.enum}' AS rule, "
                            f"count(*) FILTER (WHERE {col.name} IS NOT NULL AND {col.name} NOT IN ({dom})) AS n_bad FROM {_delivered(t)}")
            if col.char_len:
                doms.append(f"SELECT '{t}' AS table_name, '{col.name}' AS column_name, 'char({col.char_len})' AS rule, "
                            f"count(*) FILTER (WHERE {col.name} IS NOT NULL AND length({col.name}) <> {col.char_len}) AS n_bad FROM {_delivered(t)}")
    filled = []
    for t in M.TABLES:
        for c, v in M.defaults(t).items():
            if v == M.NOW:
                value, fill = f"CASE WHEN id % 2 = 0 THEN {c} END", "TIMESTAMP '2024-02-01 00:00:00'"
            else:
                value, fill = c, f"'{v}'" if isinstance(v, str) else str(v)
            filled.append(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) FILTER (WHERE coalesce({value}, {fill}) = {fill}) "
                          f"AS n_default, CAST(0 AS BIGINT) AS n_null FROM {t}")
    return {"apply_defaults_tables": "\nUNION ALL\n".join(filled), "dq_unique": "\nUNION ALL\n".join(uniq), "dq_orphans": "\nUNION ALL\n".join(refs),
            "dq_not_null": "\nUNION ALL\n".join(nulls), "dq_domain": "\nUNION ALL\n".join(doms)}


ORACLE.update(_dq_sql())



_CLASSIFIED = """
    SELECT job_name, namespace, ts, event_id, creation_ts, start_ts, completion_ts,
           active, succeeded, failed,
           CASE WHEN succeeded > 0 THEN 'Succeeded' WHEN failed > 0 THEN 'Failed'
                WHEN active > 0 THEN 'Running' ELSE 'Pending' END AS status
    FROM job_obs"""

_CHANGES = f"""
    WITH cls AS ({_CLASSIFIED}),
    lagged AS (
        SELECT *, row_number() OVER w AS rn,
               lag(status) OVER w AS p_status, lag(active) OVER w AS p_active,
               lag(succeeded) OVER w AS p_succeeded, lag(failed) OVER w AS p_failed,
               lag(completion_ts) OVER w AS p_completion
        FROM cls WINDOW w AS (PARTITION BY job_name ORDER BY ts, event_id))
    SELECT * FROM lagged
    WHERE rn = 1 OR status IS DISTINCT FROM p_status OR active IS DISTINCT FROM p_active
       OR succeeded IS DISTINCT FROM p_succeeded OR failed IS DISTINCT FROM p_failed
       OR completion_ts IS DISTINCT FROM p_completion"""

_LATEST = f"""
    SELECT * FROM ({_CLASSIFIED}) cls
    QUALIFY row_number() OVER (PARTITION BY job_name ORDER BY ts DESC, event_id DESC) = 1"""

ORACLE.update({
    "apply_defaults": """
        SELECT id, coalesce(currency, 'EUR') AS currency, coalesce(refundable, false) AS refundable,
               coalesce(refund_policy, 'non_refundable') AS refund_policy
        FROM fares""",
    "upsert_latest": f"""
        WITH ps AS ({_PAYMENT_SUMMARY}),
        upd AS (SELECT b.id, b.booking_ref, 'confirmed' AS status, b.total_amount, 1 AS src
                FROM bookings b JOIN ps ON ps.booking_id = b.id
                WHERE b.status = 'pending' AND ps.latest_payment_status = 'completed'),
        allv AS (SELECT * FROM upd UNION ALL
                 SELECT id, booking_ref, status, total_amount, 0 AS src FROM bookings)
        SELECT id, booking_ref, status, total_amount FROM allv
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY src DESC) = 1""",
    "link_reservations": """
        WITH tk AS (SELECT trip_id, seat_id, booking_id, min(id) AS tid FROM tickets
                    WHERE seat_id IS NOT NULL GROUP BY trip_id, seat_id, booking_id)
        SELECT r.id, coalesce(r.ticket_id, tk.tid) AS ticket_id
        FROM seat_reservations r LEFT JOIN tk
          ON tk.trip_id = r.trip_id AND tk.seat_id = r.seat_id
         AND tk.booking_id IS NOT DISTINCT FROM r.reserved_by_booking""",
    "delete_cascade": """
        WITH gone_trip AS (SELECT id FROM trips WHERE service_date < DATE '1996-01-01'),
        gone_ticket AS (SELECT id FROM tickets WHERE trip_id IN (SELECT id FROM gone_trip))
        SELECT 'seat_reservations' AS table_name, count(*) AS n_rows FROM seat_reservations
            WHERE trip_id NOT IN (SELECT id FROM gone_trip)
        UNION ALL SELECT 'ticket_refunds', count(*) FROM ticket_refunds
            WHERE ticket_id NOT IN (SELECT id FROM gone_ticket)
        UNION ALL SELECT 'tickets', count(*) FROM tickets WHERE id NOT IN (SELECT id FROM gone_ticket)
        UNION ALL SELECT 'trips', count(*) FROM trips WHERE id NOT IN (SELECT id FROM gone_trip)""",
    "delete_set_null": """
        SELECT t.id, CASE WHEN t.booking_id IN (SELECT id FROM bookings WHERE status = 'cancelled')
                          THEN NULL ELSE t.booking_id END AS booking_id
        FROM tickets t""",
    "delete_restrict": """
        WITH gone AS (SELECT id FROM stations WHERE region = 'AFRICA')
        SELECT 'route_stops' AS table_name, 'station_id' AS column_name, id AS child_id, station_id AS parent_id
            FROM route_stops WHERE station_id IN (SELECT id FROM gone)
        UNION ALL SELECT 'trips', 'departure_station_id', id, departure_station_id
            FROM trips WHERE departure_station_id IN (SELECT id FROM gone)
        UNION ALL SELECT 'trips', 'arrival_station_id', id, arrival_station_id
            FROM trips WHERE arrival_station_id IN (SELECT id FROM gone)""",
    "job_classify": f"SELECT job_name, event_id, ts, status, active, succeeded, failed FROM ({_CLASSIFIED}) c",
    "job_changes": f"""
        SELECT job_name, event_id, ts, status, active, succeeded, failed, completion_ts
        FROM ({_CHANGES}) ch""",
    "job_terminal_window": f"""
        WITH RECURSIVE cls AS ({_CLASSIFIED}),
        flagged AS (
            SELECT *, row_number() OVER w = 1
                      OR status IS DISTINCT FROM lag(status) OVER w
                      OR active IS DISTINCT FROM lag(active) OVER w
                      OR succeeded IS DISTINCT FROM lag(succeeded) OVER w
                      OR failed IS DISTINCT FROM lag(failed) OVER w
                      OR completion_ts IS DISTINCT FROM lag(completion_ts) OVER w AS changed
            FROM cls WINDOW w AS (PARTITION BY job_name ORDER BY ts, event_id)),
        t0 AS (SELECT job_name, ts, event_id FROM flagged WHERE status IN ('Succeeded', 'Failed')
               QUALIFY row_number() OVER (PARTITION BY job_name ORDER BY ts, event_id) = 1),
        win AS (SELECT f.job_name, f.ts, f.event_id, f.changed, f.status IN ('Succeeded', 'Failed') AS term
                FROM flagged f JOIN t0 ON t0.job_name = f.job_name
                WHERE (f.ts, f.event_id) > (t0.ts, t0.event_id) AND f.ts <= t0.ts + INTERVAL 30 SECOND),
        marks(job_name, ts, event_id) AS (
            SELECT job_name, ts, event_id FROM t0
            UNION ALL
            SELECT k.job_name, k.ts, k.event_id
            FROM (SELECT m.job_name, (SELECT min((w.ts, w.event_id)) FROM win w
                                      WHERE w.job_name = m.job_name AND w.changed
                                        AND (w.ts, w.event_id) > (m.ts, m.event_id)) AS c
                  FROM marks m) mc
            JOIN LATERAL (SELECT w.job_name, w.ts, w.event_id FROM win w
                          WHERE w.job_name = mc.job_name AND w.term AND (w.ts, w.event_id) > mc.c
                          ORDER BY w.ts, w.event_id LIMIT 1) k ON true)
        SELECT f.job_name, f.event_id, f.ts, f.status, true AS monitoring
        FROM flagged f LEFT JOIN t0 ON t0.job_name = f.job_name
        WHERE f.changed AND (t0.ts IS NULL OR f.ts <= t0.ts + INTERVAL 30 SECOND)
        UNION ALL
        SELECT f.job_name, f.event_id, f.ts, f.status, false AS monitoring
        FROM flagged f JOIN marks m ON m.job_name = f.job_name AND m.ts = f.ts AND m.event_id = f.event_id""",
    "jobs_missing": f"""
        WITH cls AS ({_CLASSIFIED}),
        polled AS (SELECT DISTINCT date_trunc('hour', ts) AS hour FROM cls),
        ended AS (SELECT job_name, min(date_trunc('hour', ts)) AS hour FROM cls
                  WHERE status IN ('Succeeded', 'Failed') GROUP BY job_name),
        sighted AS (SELECT DISTINCT job_name, date_trunc('hour', ts) AS hour FROM cls),
        gap AS (SELECT g.job_name, min(p.hour) AS missing_at
                FROM (SELECT job_name, min(hour) AS hour FROM sighted GROUP BY job_name) g
                JOIN polled p ON p.hour > g.hour
                LEFT JOIN sighted s ON s.job_name = g.job_name AND s.hour = p.hour
                WHERE s.job_name IS NULL GROUP BY g.job_name)
        SELECT gap.job_name, gap.missing_at, arg_max(cls.event_id, (cls.ts, cls.event_id)) AS event_id,
               arg_max(cls.status, (cls.ts, cls.event_id)) AS status, false AS monitoring
        FROM gap JOIN cls ON cls.job_name = gap.job_name AND cls.ts < gap.missing_at
        WHERE NOT EXISTS (SELECT 1 FROM ended e WHERE e.job_name = gap.job_name AND e.hour < gap.missing_at)
        GROUP BY gap.job_name, gap.missing_at""",
    "jobs_latest": f"""
        SELECT job_name, event_id, ts, status, active, succeeded, failed, completion_ts
        FROM ({_LATEST}) l""",
    "job_status_counts": f"""
        SELECT count(*) AS n_jobs, count(*) FILTER (WHERE status = 'Running') AS running,
               count(*) FILTER (WHERE status = 'Succeeded') AS succeeded,
               count(*) FILTER (WHERE status = 'Failed') AS failed
        FROM ({_LATEST}) l""",
    "jobs_newest_first": f"""
        SELECT job_name, creation_ts, status FROM ({_LATEST}) l ORDER BY creation_ts DESC, job_name""",
    "job_duration": f"""
        WITH l AS ({_LATEST}),
        d AS (SELECT *, CASE WHEN start_ts IS NULL THEN 0 ELSE CAST(floor(
                   (epoch_us(coalesce(completion_ts, TIMESTAMP '2024-02-01 00:00:00')) - epoch_us(start_ts))
                   / 1000000.0) AS BIGINT) END AS secs FROM l)
        SELECT job_name, status, secs AS duration_seconds,
               CASE WHEN secs IS NULL OR secs = 0 THEN '0s'
                    WHEN secs < 60 THEN CAST(secs AS VARCHAR) || 's'
                    ELSE CAST(floor(secs / 60) AS BIGINT)::VARCHAR || 'm ' || CAST(secs % 60 AS VARCHAR) || 's'
               END AS duration_text,
               strftime(creation_ts, '%Y-%m-%dT%H:%M:%SZ') AS creation_timestamp,
               strftime(start_ts, '%Y-%m-%dT%H:%M:%SZ') AS start_time,
               strftime(completion_ts, '%Y-%m-%dT%H:%M:%SZ') AS completion_time
        FROM d""",
    "job_prefix_filter": f"""
        SELECT job_name, status FROM ({_LATEST}) l WHERE starts_with(job_name, 'ticketing-report')""",
    "preferred_pod": """
        SELECT name, id, status FROM pod_records
        QUALIFY row_number() OVER (PARTITION BY name ORDER BY
            CASE WHEN status IN ('Running', 'Succeeded') THEN 0 ELSE 1 END, id) = 1""",
    "audit_payload_extract": """
        SELECT id, TRY_CAST(json_extract_string(payload, '$.k') AS INTEGER) AS k FROM audit_logs""",
    "report_name_parse": r"""
        WITH f AS (
            SELECT 'ticketing-report-' || strftime(date_trunc('month', created_at) - INTERVAL 1 MONTH, '%Y-%m-%d')
                   || '-to-' || strftime(date_trunc('month', created_at) - INTERVAL 1 DAY, '%Y-%m-%d')
                   || '-' || CAST(id % 100000 AS VARCHAR)
                   || CASE WHEN status = 'Succeeded' THEN '.xlsx' ELSE '.log' END AS file_name
            FROM pod_records)
        SELECT file_name,
               CAST(regexp_extract(file_name, '^ticketing-report-(\d{4}-\d{2}-\d{2})-to-', 1) AS DATE) AS period_start,
               CAST(regexp_extract(file_name, '-to-(\d{4}-\d{2}-\d{2})-', 1) AS DATE) AS period_end,
               regexp_extract(file_name, '-(\d+)\.xlsx$', 1) AS stamp
        FROM f WHERE ends_with(file_name, '.xlsx') ORDER BY file_name""",
    "gen_ref": """
        SELECT id, upper('BKG' || '-' || substr(md5(CAST(id AS VARCHAR)), 1, 8)) AS ref FROM bookings""",
    "pad_refs": """
        SELECT id, printf('PASS%06d', id) AS doc_number, printf('%04d', id) AS seq4 FROM passengers""",
})


ORACLE.update({
    "dq_orphan_rows": """
        SELECT t.id, t.booking_id FROM tickets t
        WHERE t.booking_id IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM bookings b WHERE b.id = t.booking_id AND b.status <> 'cancelled')""",
    # the streaming feed must equal its batch twin
    "job_feed_stream": ORACLE["job_terminal_window"],
    "job_totals_stream": ORACLE["job_status_counts"],
    "jobs_latest_stream": ORACLE["jobs_latest"],
    # polls that found the job were answered; of the others one in five was not made and one in three failed
    "jobs_missing_stream": f"""
        WITH cls AS ({_CLASSIFIED}),
        hours AS (SELECT job_name, unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)) + INTERVAL 2 HOUR, INTERVAL 1 HOUR)) AS hour
                  FROM cls GROUP BY job_name),
        sighted AS (SELECT DISTINCT job_name, date_trunc('hour', ts) AS hour FROM cls),
        ended AS (SELECT job_name, min(date_trunc('hour', ts)) AS hour FROM cls WHERE status IN ('Succeeded', 'Failed') GROUP BY job_name),
        gap AS (SELECT h.job_name, min(h.hour) AS missing_at
                FROM hours h ANTI JOIN sighted s ON s.job_name = h.job_name AND s.hour = h.hour
                WHERE (epoch(h.hour)::BIGINT // 3600 + length(h.job_name)) % 5 <> 0 AND (epoch(h.hour)::BIGINT // 3600 + length(h.job_name)) % 3 <> 0
                GROUP BY h.job_name)
        SELECT gap.job_name, gap.missing_at, arg_max(cls.event_id, (cls.ts, cls.event_id)) AS event_id,
               arg_max(cls.status, (cls.ts, cls.event_id)) AS status, false AS monitoring
        FROM gap JOIN cls ON cls.job_name = gap.job_name AND cls.ts < gap.missing_at
        WHERE NOT EXISTS (SELECT 1 FROM ended e WHERE e.job_name = gap.job_name AND e.hour < gap.missing_at)
        GROUP BY gap.job_name, gap.missing_at""",
})


_IN_WINDOW = "CAST(issued_at AS DATE) BETWEEN DATE '1998-01-01' AND DATE '1998-01-31'"
_TRIPS_IN_WINDOW = "service_date BETWEEN DATE '1998-01-01' AND DATE '1998-01-31'"
_EXPORTED = [("1998-01-01", "1998-01-31", "00001"), ("1998-02-01", "1998-02-28", "00002")]

ORACLE.update({
    "upsert_versions": """
        SELECT id, email, CASE WHEN id % 3 = 0 THEN 'version 10' ELSE full_name END AS full_name,
               CASE WHEN id % 3 = 0 THEN TIMESTAMP '2024-02-01 00:00:00' ELSE updated_at END AS updated_at FROM users
        UNION ALL SELECT id + 1000000000, email, full_name, TIMESTAMP '2024-02-01 00:00:00' FROM users WHERE id % 7 = 0""",
    "report_export": _report(_between("1998-01-01", "1998-01-31"), extra="strftime(ticket.issued_at, '%Y-%m') AS issue_month,"),
    "report_catalog": " UNION ALL ".join(
        f"SELECT 'ticketing-report-{a}-to-{b}-{n}.parquet' AS file_name, DATE '{a}' AS period_start, DATE '{b}' AS period_end, "
        f"'{n}' AS stamp, (SELECT count(*) FROM ({_report(_between(a, b))}) r) AS n_rows" for a, b, n in _EXPORTED),
    "append_log": "SELECT id, name, namespace, status, created_at FROM pod_records",
    "find_fares_by_code": f"""
        SELECT id, code, name FROM fares WHERE code IN (SELECT 'FARE-' || CAST(fare_id AS VARCHAR) FROM tickets
                                                        WHERE fare_id IS NOT NULL AND {_IN_WINDOW})""",
    "find_tickets_by_ref": """
        SELECT id, ticket_ref, status FROM tickets WHERE ticket_ref IN (SELECT printf('TKT-%08d', ticket_id) FROM ticket_refunds)""",
    "find_trains_by_registration": """
        SELECT id, registration, capacity FROM trains WHERE registration IN (SELECT registration FROM trains WHERE capacity = 300)""",
    "find_routes_by_code": f"""
        SELECT id, code FROM routes WHERE lower(code) IN (SELECT 'route-' || CAST(route_id AS VARCHAR) FROM trips WHERE {_TRIPS_IN_WINDOW})""",
    "find_stations_by_code": f"""
        SELECT id, code, region FROM stations WHERE id IN (SELECT departure_station_id FROM trips
                                                           WHERE departure_time < '10:00:00' AND {_TRIPS_IN_WINDOW})""",
    "find_seats_by_number": f"""
        SELECT id, carriage_id, seat_number FROM seats WHERE id IN (SELECT seat_id FROM tickets WHERE {_IN_WINDOW})""",
    "find_trips_by_route_and_date": f"""
        SELECT id, route_id, service_date FROM trips WHERE id IN (SELECT trip_id FROM tickets WHERE {_IN_WINDOW})""",
    "find_payments_by_status": "SELECT id, booking_id, amount FROM payments WHERE status = 'failed'",
    "find_tickets_by_status": "SELECT id, ticket_ref FROM tickets WHERE status = 'checked_in'",
    "find_stops_of_route": f"""
        SELECT id, route_id, stop_sequence, station_id FROM route_stops
        WHERE route_id IN (SELECT route_id FROM trips WHERE departure_time < '10:00:00' AND {_TRIPS_IN_WINDOW}) ORDER BY route_id, stop_sequence""",
    "find_payments_of_booking": """
        SELECT id, booking_id, amount, status FROM payments WHERE booking_id IN (SELECT id FROM bookings WHERE status = 'pending')""",
    "find_seats_of_carriage": """
        SELECT id, carriage_id, seat_number FROM seats WHERE carriage_id IN (SELECT id FROM carriages WHERE carriage_type = 'sleeper')""",
    "find_reservations_of_trip": f"""
        SELECT id, trip_id, seat_id FROM seat_reservations WHERE trip_id IN (SELECT id FROM trips WHERE {_TRIPS_IN_WINDOW})""",
    "find_tickets_of_trip": f"""
        SELECT id, trip_id, ticket_ref FROM tickets WHERE trip_id IN (SELECT id FROM trips WHERE {_TRIPS_IN_WINDOW})""",
    "find_refunds_of_ticket": f"""
        SELECT id, ticket_id, refunded_amount FROM ticket_refunds WHERE ticket_id IN (SELECT id FROM tickets WHERE {_IN_WINDOW})""",
    "find_audit_of_actor": """
        SELECT id, actor_user_id, object_type FROM audit_logs
        WHERE actor_user_id IN (SELECT user_id FROM bookings WHERE status = 'pending')""",
})

_ARRIVED = f"""
        WITH new0 AS (SELECT id, CASE WHEN id % 40 = 1 THEN printf('TKT-%08d', id - 1) ELSE ticket_ref END AS ticket_ref,
                             CASE WHEN id % 30 = 1 THEN trip_id + 1000000000000 ELSE trip_id END AS trip_id,
                             CASE WHEN id % 50 = 1 THEN -id ELSE booking_id END AS booking_id
                      FROM tickets WHERE {_IN_WINDOW}),
        new AS (SELECT * FROM new0 UNION ALL SELECT id, ticket_ref || '-B', trip_id, booking_id FROM new0 WHERE id % 70 = 1),
        old AS (SELECT * FROM tickets WHERE NOT ({_IN_WINDOW}))"""

ORACLE.update({
    "report_custom_windows": f"""
        WITH weeks AS (SELECT DISTINCT CAST(date_trunc('week', issued_at) AS DATE) AS start FROM tickets),
        r AS ({_report()})
        SELECT strftime(weeks.start, '%Y-%m-%d') AS window_id, r.ticket_ref, r.issued_at, r.ticket_price, r.booking_ref, r.paid_amount, r.departure_station_code
        FROM r JOIN weeks ON CAST(r.issued_at AS DATE) BETWEEN weeks.start AND weeks.start + 9""",
    "dq_arrivals_unique": _ARRIVED + """
        SELECT 'tickets' AS table_name, c AS key_columns, '["' || key || '"]' AS key_value, sum(n) AS n_batch, sum(o) AS n_stored
        FROM (SELECT 'id' AS c, CAST(id AS VARCHAR) AS key, 1 AS n, 0 AS o FROM new UNION ALL SELECT 'ticket_ref', ticket_ref, 1, 0 FROM new
              UNION ALL SELECT 'id', CAST(id AS VARCHAR), 0, 1 FROM old UNION ALL SELECT 'ticket_ref', ticket_ref, 0, 1 FROM old) x
        WHERE key IS NOT NULL GROUP BY c, key HAVING sum(n) > 0 AND sum(n) + sum(o) > 1""",
    "dq_arrivals_orphans": _ARRIVED + """
        SELECT 'tickets' AS table_name, 'trip_id' AS column_name, 'trips' AS parent_table, '["' || trip_id || '"]' AS key_value, count(*) AS n_rows
        FROM new WHERE trip_id NOT IN (SELECT id FROM trips) GROUP BY trip_id
        UNION ALL SELECT 'tickets', 'booking_id', 'bookings', '["' || booking_id || '"]', count(*)
        FROM new WHERE booking_id NOT IN (SELECT id FROM bookings) GROUP BY booking_id""",
    "ticket_report_bucketed": ORACLE["ticket_report"],
    "upsert_ranges": ORACLE["upsert_latest"],
    "link_ranges": ORACLE["link_reservations"],
    "ticket_report_api_default": ORACLE["ticket_report_mtd"],
    "report_row_count": f"SELECT count(*) AS counted, count(*) AS in_files FROM tickets JOIN trips ON trips.id = tickets.trip_id WHERE {_IN_WINDOW}",
    "short_refs": "SELECT id, upper(substr(md5(CAST(id AS VARCHAR)), 1, 8)) AS ref FROM bookings",
    "checked_doc_types": "SELECT id, doc_type FROM passengers WHERE doc_type IS NULL OR doc_type IN ('id_card', 'passport', 'other')",
    "job_null_counters": """
        WITH o AS (SELECT name AS job_name, id AS event_id,
                          CASE WHEN id % 2 <> 0 THEN CASE WHEN status = 'Running' THEN 1 ELSE 0 END END AS a,
                          CASE WHEN id % 3 <> 0 THEN CASE WHEN status = 'Succeeded' THEN 1 ELSE 0 END END AS s,
                          CASE WHEN id % 4 <> 0 THEN CASE WHEN status = 'Failed' THEN 1 ELSE 0 END END AS f FROM pod_records),
        n AS (SELECT *, a IS NULL AND s IS NULL AND f IS NULL AS none FROM o)
        SELECT job_name, event_id, CASE WHEN NOT none THEN coalesce(a, 0) END AS active, CASE WHEN NOT none THEN coalesce(s, 0) END AS succeeded,
               CASE WHEN NOT none THEN coalesce(f, 0) END AS failed,
               CASE WHEN none THEN NULL WHEN s > 0 THEN 'Succeeded' WHEN f > 0 THEN 'Failed' WHEN a > 0 THEN 'Running' ELSE 'Pending' END AS status
        FROM n""",
    "job_period_labels": """
        SELECT id AS event_id, CASE WHEN id % 4 <> 0 THEN strftime(date_trunc('month', created_at), '%Y-%m-%d') END AS start_date,
               CASE WHEN id % 4 > 1 THEN strftime(last_day(created_at), '%Y-%m-%d') END AS end_date FROM pod_records""",
    "report_listing": """
        SELECT DISTINCT_NAMES.file_name FROM (SELECT DISTINCT status, 'ticketing-report-' || strftime(created_at, '%Y-%m-%d') || '-to-'
               || strftime(created_at, '%Y-%m-%d') || '-1.xlsx' AS file_name FROM pod_records) AS DISTINCT_NAMES""",
})

_PAYLOADS = """
        WITH p AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN props
                     WHEN 1 THEN '{"k": "' || event_type || '", "weight": ' || user_id || '.5}'
                     WHEN 2 THEN '{"k": ' || event_id || ', "by": {"user": ' || user_id || '}, "tags": ["' || event_type || '"]}'
                     WHEN 3 THEN left(props, length(props) - 1) ELSE '[' || user_id || ', null]' END AS payload FROM events)"""

ORACLE.update({
    "payload_keys": _PAYLOADS + """,
        o AS (SELECT payload FROM p WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
        k AS (SELECT payload, unnest(json_keys(payload)) AS key FROM o),
        j AS (SELECT key, json_type(payload, '$.' || key) AS t FROM k),
        a AS (SELECT NULL AS key, CASE WHEN NOT json_valid(payload) THEN 'malformed' ELSE json_type(payload) END AS t FROM p
              WHERE NOT json_valid(payload) OR json_type(payload) <> 'OBJECT')
        SELECT key, CASE t WHEN 'malformed' THEN t WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string'
                           WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind, count(*) AS n
        FROM (SELECT * FROM j UNION ALL SELECT * FROM a) GROUP BY ALL""",
    "payload_typed": _PAYLOADS + """
        SELECT event_id, NOT json_valid(payload) AS malformed, json_extract_string(s, '$.k') AS k, CAST(json_extract(s, '$.weight') AS DOUBLE) AS weight,
               CAST(json_extract(s, '$.by.user') AS BIGINT) AS by_user, json_extract_string(s, '$.tags[0]') AS first_tag
        FROM (SELECT *, CASE WHEN json_valid(payload) THEN payload END AS s FROM p)""",
})


def oracle_queries() -> dict[str, str]:
    return {k: with_domain(v) for k, v in ORACLE.items()}
