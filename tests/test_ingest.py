import json

import pytest
from pyspark.sql import functions as F

from railyard.functions.enums import checked_enum
from railyard.operators import jobs as JB
from railyard.sources.json_ingest import json_field, label, payload_variant, pod_list_items

DOC = {"items": [
    {"metadata": {"name": "ticketing-report-1-abc", "labels": {"app": "ticketing-report"}},
     "status": {"phase": "Failed"}},
    {"metadata": {"name": "ticketing-report-1-def", "labels": {"app": "ticketing-report"}},
     "status": {"phase": "Succeeded"}},
]}


def test_pod_list_and_preference(spark):
    docs = spark.createDataFrame([("job-1", json.dumps(DOC)), ("job-2", "{not json")], "job string, json string")
    pods = pod_list_items(docs, keep=["job"])
    rows = pods.orderBy("ord").collect()
    assert [(r.name, r.phase, r.ord) for r in rows] == [("ticketing-report-1-abc", "Failed", 0),
                                                         ("ticketing-report-1-def", "Succeeded", 1)]
    pick = JB.preferred_pod(pods.select("job", "ord", "name", "phase"), group="job", phase="phase", order="ord")
    assert [r.name for r in pick.collect()] == ["ticketing-report-1-def"]


def test_json_field_and_variant(spark):
    df = spark.createDataFrame([('{"k": 69}',), ("garbage",), (None,)], "p string")
    assert [r[0] for r in df.select(json_field(F.col("p"), "$.k", "int")).collect()] == [69, None, None]
    v = df.select(F.variant_get(payload_variant(F.col("p")), "$.k", "int").alias("k")).collect()
    assert [r.k for r in v] == [69, None, None]


def test_labels(spark):
    df = spark.createDataFrame([({"start-date": "2024-01-01", "end-date": "2024-01-31"},), ({},), (None,)],
                               "labels map<string,string>")
    assert [r[0] for r in df.select(label(F.col("labels"), "start-date")).collect()] == ["2024-01-01", None, None]
    out = JB.with_period_labels(df).collect()
    assert (out[0].start_date, out[0].end_date) == ("2024-01-01", "2024-01-31")


def test_checked_enum(spark):
    ok = spark.createDataFrame([("passport",), (None,)], "d string")
    assert [r[0] for r in ok.select(checked_enum("d", "doc_type")).collect()] == ["passport", None]
    bad = spark.createDataFrame([("license",)], "d string")
    with pytest.raises(Exception, match="unknown doc_type value"):
        bad.select(checked_enum("d", "doc_type")).collect()


def test_streaming_append_sink(spark, tmp_path):
    from railyard.streaming.job_feed import append_sink
    src = tmp_path / "src"
    spark.createDataFrame([(1, "a")], "id long, name string").write.parquet(str(src / "f1"))
    stream = spark.readStream.schema("id long, name string").option("recursiveFileLookup", "true").parquet(str(src))
    append_sink(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    spark.createDataFrame([(2, "b")], "id long, name string").write.parquet(str(src / "f2"))
    append_sink(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_foreign_names_and_crlf_listings(spark):
    from railyard.sources.catalog import listing_lines, parse_report_names
    names = spark.createDataFrame([("summary.xlsx",), ("ticketing-report-2024-01-01-to-2024-01-31-7.xlsx",)], "file_name string")
    assert [r.period_start is None for r in parse_report_names(names).collect()] == [True, False]
    text = spark.createDataFrame([("a.xlsx\r\n\tb.xlsx\r\n \r\n",)], "text string")
    assert [r.file_name for r in listing_lines(text).collect()] == ["a.xlsx", "b.xlsx"]
