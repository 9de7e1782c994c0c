import datetime as dt

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from railyard import schemas
from railyard.operators import quality as DQ
from railyard.operators import writes as WR

TS = dt.datetime(2024, 6, 1, 12, 0, 0)


def test_defaults(spark):
    df = spark.createDataFrame([(1, None, None, None, None)],
                               "id long, currency string, status string, issued_at timestamp, price decimal(12,2)")
    r = WR.apply_defaults(df, "tickets", TS).collect()[0]
    assert r.currency == "EUR" and r.status == "issued" and r.issued_at == TS and r.price is None


def test_upsert_touches_updated_at(spark, seed):
    users = seed["users"]
    upd = users.filter("id = 3").withColumn("full_name", F.lit("Renamed")) \
        .withColumn("updated_at", F.lit(dt.datetime(1999, 1, 1)).cast("timestamp"))
    new = spark.createDataFrame([(99, "new@x.com")], "id long, email string")
    new = new.select(*[F.col(c) if c in new.columns else F.lit(None).cast(users.schema[c].dataType).alias(c)
                       for c in users.columns])
    out = {r.id: r for r in WR.upsert(users, upd.unionByName(new), touch="updated_at", batch_ts=TS).collect()}
    assert len(out) == 11
    assert out[3].full_name == "Renamed" and out[3].updated_at == TS
    assert out[4].updated_at != TS and out[99].updated_at == TS


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 100)), max_size=12),
       st.lists(st.tuples(st.integers(0, 8), st.integers(0, 100)), max_size=12))
def test_upsert_idempotent_and_latest(spark, base, upd):
    b = spark.createDataFrame(base, "id int, v int") if base else spark.createDataFrame([], "id int, v int")
    u = spark.createDataFrame(upd, "id int, v int") if upd else spark.createDataFrame([], "id int, v int")
    once = WR.upsert(b, u)
    twice = WR.upsert(once, u)
    a = sorted(tuple(r) for r in once.collect())
    assert a == sorted(tuple(r) for r in twice.collect())
    upd_ids = {i for i, _ in upd}
    # keys in the batch: exactly one row, the batch's greatest value (ties broken by the row)
    expected = [(i, max(x for j, x in upd if j == i)) for i in sorted(upd_ids)]
    # keys not in the batch: every base row untouched (nothing dropped, even duplicates)
    expected += [(i, v) for i, v in base if i not in upd_ids]
    assert a == sorted(expected)


def test_link_reservations(seed):
    linked = WR.link_reservations(seed["seat_reservations"], seed["tickets"]).collect()
    assert len(linked) == 20 and all(r.ticket_id == r.id for r in linked)


def test_cascade_leaves_no_orphans(seed):
    tables = WR.delete_rows(seed, "trips", seed["trips"].filter("id = 1"))
    assert tables["trips"].count() == 4
    assert tables["tickets"].count() == 16
    assert tables["seat_reservations"].count() == 16
    summ = DQ.reference_summary(tables).collect()
    assert all(r.n_orphans == 0 for r in summ)


def test_set_null(seed):
    tables = WR.delete_rows(seed, "bookings", seed["bookings"].filter("status = 'pending'"))
    assert tables["payments"].count() == 16
    t = tables["tickets"]
    assert t.count() == 20 and t.filter("booking_id IS NULL").count() == 4
    assert tables["seat_reservations"].filter("reserved_by_booking IS NULL").count() == 4


def test_restrict(seed):
    with pytest.raises(WR.RestrictViolation):
        WR.delete_rows(seed, "stations", seed["stations"].filter("code = 'ROM'"))
    # an unreferenced station may go
    tables = WR.delete_rows(seed, "stations", seed["stations"].filter("code = 'GEN'"))
    assert tables["stations"].count() == 7


@settings(max_examples=6, deadline=None)
@given(st.sets(st.integers(0, 19), max_size=6))
def test_cascade_property(seed, doomed):
    ids = seed.spark.createDataFrame([(i,) for i in doomed], "id long") if doomed else \
        seed.spark.createDataFrame([], "id long")
    tables = WR.delete_rows(seed, "bookings", ids)
    assert tables["bookings"].count() == 20 - len(doomed)
    assert all(r.n_orphans == 0 for r in DQ.reference_summary(tables).collect())


def test_upsert_compares_versions_as_numbers(spark):
    from railyard.operators.writes import upsert
    base = spark.createDataFrame([(1, "old", 1)], "id long, v string, version int")
    new = spark.createDataFrame([(1, "nine", 9), (1, "ten", 10)], "id long, v string, version int")
    assert [r.v for r in upsert(base, new, order="version").collect()] == ["ten"]
