from pyspark.sql import functions as F

from railyard import schemas
from railyard.operators import quality as DQ
from railyard.operators import writes as WR


def test_unique_finds_duplicate_pairs(adapter_small):
    v = DQ.unique_violations(adapter_small, ["payments"]).collect()
    assert v and all(r.table_name == "payments" and r.n_rows > 1 for r in v)


def test_partial_unique_ignores_null_seats(spark, seed):
    t = seed["tickets"]
    dup = t.limit(2).withColumn("seat_id", F.lit(None).cast("long"))
    tables = seed.with_overrides(tickets=t.unionByName(dup).unionByName(dup))
    assert DQ.partial_unique_violations(tables).count() == 0
    dup2 = t.filter("id = 3").withColumn("id", F.lit(1000).cast("long"))
    tables = seed.with_overrides(tickets=t.unionByName(dup2))
    assert [r.key_value for r in DQ.partial_unique_violations(tables).collect()] == ['["3","3"]']


def test_orphans_after_injected_parent_loss(seed):
    tables = seed.with_overrides(bookings=seed["bookings"].filter("id % 11 != 0"))
    fk = next(f for f in schemas.FOREIGN_KEYS if f.child == "tickets" and f.column == "booking_id")
    assert sorted(r.id for r in DQ.orphans(tables, fk).collect()) == [0, 11]
    summ = {(r.table_name, r.column_name): r.n_orphans for r in DQ.reference_summary(tables).collect()}
    assert summ[("tickets", "booking_id")] == 2 and summ[("payments", "booking_id")] == 2


def test_null_and_domain_profiles(seed):
    bad = seed["tickets"].withColumn("status", F.when(F.col("id") == 0, "lost").otherwise(F.col("status")))
    bad = bad.withColumn("currency", F.when(F.col("id") == 1, "EURO").otherwise(F.col("currency")))
    bad = bad.withColumn("ticket_ref", F.when(F.col("id") == 2, None).otherwise(F.col("ticket_ref")))
    t = seed.with_overrides(tickets=bad)
    dom = {(r.column_name, r.rule): r.n_bad for r in DQ.domain_profile(t, ["tickets"]).collect()}
    assert dom[("status", "enum:ticket_status")] == 1 and dom[("currency", "char(3)")] == 1
    nn = {r.column_name: r.n_null for r in DQ.null_profile(t, ["tickets"]).collect()}
    assert nn["ticket_ref"] == 1 and nn["trip_id"] == 0


def test_decimal_fit(spark):
    df = spark.createDataFrame([(1.5,), (123456789.0,), (None,)], "x double")
    r = DQ.decimal_fit(df, "t", "x", 10, 2).collect()[0]
    assert (r.n_values, r.n_overflow) == (2, 1)


def test_enum_violations(spark):
    df = spark.createDataFrame([("pending",), ("PAID",), (None,)], "status string")
    assert DQ.enum_violations(df, "status", "payment_status").count() == 1


def test_absent_columns_and_unused_references_are_reported(seed):
    t = seed.with_overrides(tickets=seed["tickets"].drop("ticket_ref", "status"))
    assert {r.column_name: r.n_null for r in DQ.null_profile(t, ["tickets"]).collect()}["ticket_ref"] == 20
    assert {r.rule: r.n_bad for r in DQ.domain_profile(t, ["tickets"]).collect()}["enum:ticket_status"] is None
    rows = DQ.reference_summary(seed.with_overrides(tickets=seed["tickets"].filter("false"))).collect()
    assert len(rows) == len(schemas.FOREIGN_KEYS)
    assert {(r.table_name, r.column_name): r.n_refs for r in rows}["tickets", "fare_id"] == 0
