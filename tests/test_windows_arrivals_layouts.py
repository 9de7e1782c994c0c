"""Many overlapping windows, arriving batches, bucketed tickets, upserts in key ranges, payloads of unknown shape."""

import datetime as dt
import json
import os
import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from railyard import schemas
from railyard.operators import writes as WR
from railyard.operators.arrivals import arriving_duplicates, arriving_orphans, bloom, key_text, might_contain
from railyard.plans import report as R
from railyard.plans.window import Window
from railyard.sources.adapter import StarAdapter
from railyard.sources.bucketed import BucketedDomain, read_bucketed, tickets_with_bookings, write_bucketed
from railyard.sources.export import append_records
from railyard.sources.payloads import key_profile, parsed, shape, typed
from railyard.sources.ranged import RangedTable
from railyard.sources.stored import stored_adapter


@pytest.fixture(scope="module")
def tables(spark):
    return stored_adapter(StarAdapter(spark, SF_SMALL))


def plan(df):
    return df._jdf.queryExecution().toString()


# windows --------------------------------------------------------------------------
def test_hundreds_of_windows_equal_the_report_of_each(spark, tables):
    first = dt.date(1995, 1, 1)
    spans = [(first + dt.timedelta(days=7 * i), first + dt.timedelta(days=7 * i + i % 40)) for i in range(250)]
    spans.append((dt.date(1980, 1, 1), dt.date(1980, 1, 31)))          # no tickets
    windows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(spans)], "window_id int, start date, end date")
    got = R.report_windows(tables, windows, ["ticket_ref", "issued_at", "booking_ref"])
    counts = {r.window_id: r["count"] for r in got.groupBy("window_id").count().collect()}
    issued = [r.d for r in tables["tickets"].select(F.to_date("issued_at").alias("d")).collect()]
    assert counts == {i: n for i, (a, b) in enumerate(spans) if (n := sum(a <= d <= b for d in issued))}
    for i in (3, 111, 249):
        one = R.ticket_report(tables, Window(*spans[i]), ordered=False, columns=["ticket_ref", "issued_at", "booking_ref"])
        assert sorted(map(tuple, got.filter(F.col("window_id") == i).drop("window_id").collect())) == sorted(map(tuple, one.collect()))


def test_window_plan_is_an_equi_join_over_one_scan_of_tickets(spark, tables):
    windows = spark.createDataFrame([(1, dt.date(1998, 1, 1), dt.date(1998, 1, 20))], "window_id int, start date, end date")
    text = plan(R.report_windows(tables, windows)).split("== Physical Plan ==")[1]
    assert not re.search("NestedLoop|CartesianProduct", text)
    assert len(re.findall(r"FileScan parquet.*ticket_ref", text)) == 1 and "issue_month" in text


def test_wrong_windows_are_refused(spark, tables):
    day = dt.date(1998, 1, 1)
    for start, end in [(day, day - dt.timedelta(days=1)), (None, day), (day, None)]:
        with pytest.raises(ValueError):
            R.report_windows(tables, spark.createDataFrame([(1, start, end)], "window_id int, start date, end date"))
    none = spark.createDataFrame([], "window_id int, start date, end date")
    assert R.report_windows(tables, none).count() == 0


# arriving batches ------------------------------------------------------------------
def test_bloom_filter_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(0, 20_000, 2).select(F.col("id").cast("string").alias("key"))
    words, bits = bloom(keys, "key")
    assert bits >= 10_000 * 16
    tested = spark.range(40_000).select("id", might_contain(words, bits, F.col("id").cast("string")).alias("may"))
    hit, wrong = tested.agg(F.count_if((F.col("id") % 2 == 0) & (F.col("id") < 20_000) & F.col("may")), F.count_if(
        ((F.col("id") % 2 == 1) | (F.col("id") >= 20_000)) & F.col("may"))).first()
    assert hit == 10_000 and wrong < 30_000 * 0.02


def test_arriving_duplicates_and_orphans(spark):
    stored = spark.createDataFrame([(i, f"T{i}") for i in range(1000)], "id long, ticket_ref string")
    batch = spark.createDataFrame([(5, "N1"), (2000, "T7"), (2001, "N2"), (2002, "N2"), (2003, None), (2004, None), (None, "N3")], "id long, ticket_ref string")
    got = {(r.key_columns, *json.loads(r.key_value), r.n_batch, r.n_stored) for r in arriving_duplicates(stored, batch, "tickets").collect()}
    assert got == {("id", "5", 1, 1), ("ticket_ref", "T7", 1, 1), ("ticket_ref", "N2", 2, 0)}
    pairs = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("a|b", "c")], "code string, id string")
    two = arriving_duplicates(pairs.limit(0), pairs, "x", [("code", "id")])
    assert [json.loads(r.key_value) for r in two.collect()] == [["a|b", "c"]]
    fk = next(f for f in schemas.FOREIGN_KEYS if f.child == "payments")
    children = spark.createDataFrame([(1,), (1,), (9999,), (9999,), (3000,), (None,)], "booking_id long")
    parents = stored.select("id")
    assert [(r.key_value, r.n_rows) for r in arriving_orphans(parents, children, fk, spark.createDataFrame([(3000,)], "id long")).collect()] == [('["9999"]', 2)]
    assert arriving_orphans(parents, children.filter("false"), fk).count() == 0
    assert arriving_orphans(parents.filter("false"), children, fk).count() == 3


def test_stored_rows_pass_the_filter_before_they_are_exchanged(spark, tables):
    stored, batch = tables["tickets"], tables["tickets"].limit(50)
    seen = stored.select(key_text(["ticket_ref"]).alias("key"))
    words, bits = bloom(batch.select(key_text(["ticket_ref"]).alias("key")), "key")
    assert 50 <= seen.filter(might_contain(words, bits, F.col("key"))).count() < stored.count() / 20
    text = plan(arriving_duplicates(stored, batch, "tickets", [("ticket_ref",)])).split("== Optimized Logical Plan ==")[1].split("== Physical")[0]
    # the filter stands on the scan's side of the aggregation that exchanges the stored keys
    assert re.search(r"Aggregate \[key#\d+\], \[key#\d+, count\(1\) AS n_stored.*\n.*\+- (Project.*\n.*\+- )?Filter", text)


# buckets ----------------------------------------------------------------------------
def test_bucketed_joins_have_no_exchange(spark, tables, tmp_path):
    root = str(tmp_path / "b4")
    write_bucketed(tables, root, 4)
    stored = read_bucketed(spark, root, 4)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = tickets_with_bookings(stored)
        text = plan(met).split("== Physical Plan ==")[1]
        assert "Exchange" not in text and text.count("SortMergeJoin") == 2
        assert len([f for f in os.listdir(f"{root}/tickets_booked") if f.endswith(".parquet")]) == 4
        assert met.count() == tables["tickets"].count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_bucketed_report_and_a_new_catalogue(spark, tables, tmp_path):
    domain = BucketedDomain(tables, str(tmp_path / "b3"), 3)
    key = lambda df: sorted(map(str, df.collect()))
    want = key(R.ticket_report(tables, None, ordered=False))
    assert key(R.ticket_report(domain, None, ordered=False)) == want
    for t in spark.catalog.listTables():
        if t.name.endswith("_b3"):
            spark.sql(f"DROP TABLE {t.name}")                # as a new application finds it
    again = BucketedDomain(tables, str(tmp_path / "b3"), 3)
    assert key(R.ticket_report(again, None, ordered=False)) == want
    columns = ["ticket_ref", "paid_amount"]
    assert key(R.ticket_report(again, Window(dt.date(1998, 1, 1), dt.date(1998, 1, 31)), columns=columns)) == key(
        R.ticket_report(tables, Window(dt.date(1998, 1, 1), dt.date(1998, 1, 31)), columns=columns))


# upserts in ranges -------------------------------------------------------------------
def test_upsert_into_ranges_equals_upsert(spark, tables, tmp_path):
    users = tables["users"]
    stored = RangedTable(spark, str(tmp_path / "users"), users.schema, "id", ranges=64)
    stored.create(users)
    few = users.filter("id <= 2").withColumn("full_name", F.lit("new"))
    changes = few.unionByName(few.withColumn("full_name", F.lit("newer"))).unionByName(users.limit(1).withColumn("id", F.lit(10**9).cast(users.schema["id"].dataType)))
    when = dt.datetime(2024, 2, 1)
    touched = WR.upsert_into(stored, changes, order="full_name", touch="updated_at", batch_ts=when)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(stored.read()) == key(WR.upsert(users, changes, order="full_name", touch="updated_at", batch_ts=when))
    assert 1 <= len(touched) <= 3


def test_link_back_writes_only_the_linked(spark, tables, tmp_path):
    r = tables["seat_reservations"]
    stored = RangedTable(spark, str(tmp_path / "r"), r.schema, "id", ranges=32)
    stored.create(r)
    WR.link_reservations_into(stored, tables["tickets"])
    key = lambda df: sorted(map(str, df.collect()))
    assert key(stored.read()) == key(WR.link_reservations(r, tables["tickets"]))
    assert WR.link_reservations_into(stored, tables["tickets"].limit(0)) == []


# payloads ------------------------------------------------------------------------------
def test_payload_profile_and_typed_columns(spark):
    texts = ['{"a": 1, "b": {"c": "x"}, "d e": true}', '{"a": "one", "l": [1, 2]}', '{"a": null}', '[1]', '7', '{"a": 1', "", None, '{"big": 12345678901234567890}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, payload string")
    got = {(r.key, r.kind): r.n for r in key_profile(df, "payload").collect()}
    assert got == {("a", "number"): 1, ("a", "string"): 1, ("a", "null"): 1, ("b", "object"): 1, ("d e", "boolean"): 1, ("l", "array"): 1,
                   ("big", "number"): 1, (None, "array"): 1, (None, "number"): 1, (None, "malformed"): 2}
    fields = {f.name: f.dataType.simpleString() for f in shape(df, "payload")}
    assert fields["a"] == "variant" and fields["b"] == "struct<c:string>" and fields["l"] == "array<bigint>" and fields["d e"] == "boolean"
    rows = {r.id: r for r in typed(df, "payload").select("id", "malformed", F.col("payload.a").cast("string").alias("a"), "payload.b.c", "payload.`d e`").collect()}
    assert [rows[i].a for i in range(3)] == ["1", "one", None] and rows[0].c == "x" and rows[0]["d e"] is True
    assert [i for i in rows if rows[i].malformed] == [5, 6]
    assert parsed(df.limit(0), "payload").count() == 0 and len(shape(df.filter("id = 7"), "payload")) == 0


def test_append_of_a_batch_that_runs_again(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.range(5)
    for batch in ("a", "b", "b"):
        append_records(rows, path, batch=batch)
    assert spark.read.parquet(path).count() == 10


def test_command_line_refuses_unknown_columns(capsys):
    from railyard.cli import main
    assert main(["--source", "nowhere", "--columns", "ticket_ref,nothing"]) == 2
    assert "nothing" in capsys.readouterr().err
