import datetime as dt

from railyard.plans import report as R
from railyard.plans.window import Window
from railyard.sources.catalog import listing_lines, report_catalog
from railyard.sources.export import append_records, export_report


def test_export_roundtrip_and_catalog(spark, adapter_small, tmp_path):
    w = Window(dt.date(1998, 1, 1), dt.date(1998, 3, 31))
    rep = R.ticket_report(adapter_small, w)
    path, n = export_report(rep, str(tmp_path), w.start, w.end, 42)
    back = spark.read.parquet(path)
    assert n == rep.count() == back.count()
    assert dict(back.dtypes)["issued_at"] == "timestamp_ntz"
    cols = R.REPORT_COLUMNS
    a = sorted(tuple(r) for r in rep.select(*cols).collect())
    b = sorted(tuple(r) for r in back.select(*cols).collect())
    assert [x[:4] + x[5:] for x in a] == [x[:4] + x[5:] for x in b]
    assert {r.issue_month for r in back.select("issue_month").distinct().collect()} == \
        {"1998-01", "1998-02", "1998-03"}
    export_report(rep, str(tmp_path), w.start, w.end, 43, fmt="csv", partition_by=None)
    cat = report_catalog(spark, str(tmp_path), pattern="*.parquet").collect()
    assert [(r.file_name, r.period_start, r.period_end) for r in cat] == \
        [("ticketing-report-1998-01-01-to-1998-03-31-42.parquet", w.start, w.end)]
    assert report_catalog(spark, str(tmp_path), pattern="*.csv").count() == 1


def test_append_log(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    append_records(df, str(tmp_path / "log"))
    append_records(df.filter("id = 1"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 3


def test_listing_lines(spark):
    df = spark.createDataFrame([("a.xlsx\n  b.xlsx \n\n   \nc.log",)], "text string")
    assert [r.file_name for r in listing_lines(df).collect()] == ["a.xlsx", "b.xlsx", "c.log"]


def test_catalog_lists_newest_name_first(spark, adapter_small, tmp_path):
    for (a, b, st) in [((1998, 1, 1), (1998, 1, 31), 1), ((1998, 2, 1), (1998, 2, 28), 2)]:
        w = Window(dt.date(*a), dt.date(*b))
        export_report(R.ticket_report(adapter_small, w, ordered=False), str(tmp_path), w.start, w.end, st)
    names = [r.file_name for r in report_catalog(spark, str(tmp_path), pattern="*.parquet").collect()]
    assert names == sorted(names, reverse=True) and len(names) == 2
    asc = [r.file_name for r in report_catalog(spark, str(tmp_path), pattern="*.parquet", descending=False).collect()]
    assert asc == sorted(names)
