"""Report catalogue: produced report files and the period encoded in their names.

File names follow ``ticketing-report-{start}-to-{end}-{stamp}.xlsx``.  The
catalogue is a DataFrame over file metadata (``binaryFile`` reading only
path, length and modification time — never the content), filtered by suffix,
with the period parsed from the name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Report file naming.
REPORT_PREFIX = "ticketing-report"
REPORT_SUFFIX = ".xlsx"
NAME_PATTERN = r"^ticketing-report-(\d{4}-\d{2}-\d{2})-to-(\d{4}-\d{2}-\d{2})-(\d+)\.[A-Za-z0-9]+$"


def report_file_name(start: F.Column, end: F.Column, stamp: F.Column, ext: F.Column) -> F.Column:
    return F.concat(F.lit(REPORT_PREFIX + "-"), F.date_format(start, "yyyy-MM-dd"), F.lit("-to-"),
                    F.date_format(end, "yyyy-MM-dd"), F.lit("-"), stamp.cast("string"), F.lit("."), ext)


def report_file_names(pod_records: DataFrame) -> DataFrame:
    """The file each finished report pod leaves behind: a previous-month report
    named with a short stamp; failed pods leave a ``.log`` instead."""
    d = F.to_date("created_at")
    start = F.add_months(F.trunc(d, "MM"), -1)
    end = F.date_sub(F.trunc(d, "MM"), 1)
    ext = F.when(F.col("status") == "Succeeded", F.lit("xlsx")).otherwise(F.lit("log"))
    return pod_records.select(report_file_name(start, end, F.pmod(F.col("id"), F.lit(100000)), ext)
                              .alias("file_name"))


def parse_report_names(names: DataFrame, column: str = "file_name", ordered: bool = True,
                       suffix: str = REPORT_SUFFIX) -> DataFrame:
    """Keep report files (suffix filter) and parse their period and stamp."""
    n = F.col(column)
    out = names.filter(n.endswith(suffix)).select(
        n.alias("file_name"),
        F.try_to_date(F.regexp_extract(n, NAME_PATTERN, 1)).alias("period_start"),
        F.try_to_date(F.regexp_extract(n, NAME_PATTERN, 2)).alias("period_end"),
        F.regexp_extract(n, NAME_PATTERN, 3).alias("stamp"))
    return out.orderBy("file_name") if ordered else out


def report_catalog(spark: SparkSession, root: str, pattern: str = f"*{REPORT_SUFFIX}",
                   descending: bool = True) -> DataFrame:
    """Catalogue of reports under ``root``: one row per report, with its
    period, total bytes, file count and last modification, newest name first
    (as the dashboard lists them).

    A report is either a single file or a dataset folder whose name carries
    the period; ``binaryFile`` lists the files with only path, length and
    mtime selected, so no file content is read.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
             .select("path", "length", "modificationTime"))
    segs = F.split(F.col("path"), "/")
    name = F.filter(segs, lambda s: s.rlike(NAME_PATTERN))
    # a file of the wanted suffix without a period in its name is a report of its own
    named = (files.withColumn("file_name", F.coalesce(F.get(name, F.lit(0)), F.element_at(segs, -1)))
                  .filter(F.col("file_name").isNotNull())
                  .filter(F.col("file_name").like(pattern.replace("*", "%"))))
    agg = named.groupBy("file_name").agg(
        F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("files"),
        F.max("modificationTime").alias("modified"))
    parsed = parse_report_names(agg.select("file_name"), suffix=pattern.lstrip("*"),
                                ordered=False).join(agg, "file_name")
    return parsed.orderBy(F.col("file_name").desc() if descending else F.col("file_name"))


def listing_lines(listing: DataFrame, column: str = "text") -> DataFrame:
    """Split a directory-listing text into names: one per line, trimmed, blanks dropped."""
    return (listing.select(F.explode(F.split(F.col(column), "\n")).alias("line"))
            .select(F.regexp_replace("line", r"^\s+|\s+$", "").alias("file_name")).filter(F.col("file_name") != ""))
