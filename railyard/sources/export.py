"""Report export and append-only record logs.

The reference fetches every report row into one process and writes one
workbook.  Here the report stays distributed: each task writes its own
files, zone-aware timestamps are written zone-less (the export's rule), the
dataset is partitioned by issue month, and the row count comes from an
``Observation`` collected during the same write — no second pass.
"""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railyard.sources.catalog import REPORT_PREFIX


def strip_zones(df: DataFrame) -> DataFrame:
    """Zone-aware timestamps → zone-less wall-clock values in the session zone."""
    return df.select(*[F.col(f.name).cast("timestamp_ntz").alias(f.name)
                       if isinstance(f.dataType, T.TimestampType) else F.col(f.name)
                       for f in df.schema.fields])


def report_dataset_name(start: dt.date, end: dt.date, stamp: str | int, fmt: str = "parquet") -> str:
    return f"{REPORT_PREFIX}-{start.isoformat()}-to-{end.isoformat()}-{stamp}.{fmt}"


def export_report(report: DataFrame, root: str, start: dt.date, end: dt.date, stamp: str | int,
                  fmt: str = "parquet", partition_by: str | None = "issue_month") -> tuple[str, int]:
    """Write ``report`` as one dataset under ``root`` (overwrite) and return
    ``(path, rows_written)``.

    ``partition_by="issue_month"`` adds ``yyyy-MM`` of ``issued_at`` as the
    directory key, so month windows read back with partition pruning.  An
    ordered report keeps its order within each written file.
    """
    path = os.path.join(root, report_dataset_name(start, end, stamp, fmt))
    df = strip_zones(report)
    if partition_by == "issue_month" and "issued_at" not in df.columns:
        partition_by = None   # a column subset without the issue time: one flat dataset
    if partition_by == "issue_month":
        df = df.withColumn("issue_month", F.date_format("issued_at", "yyyy-MM"))
    obs = Observation("export")
    df = df.observe(obs, F.count(F.lit(1)).alias("rows"))
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(path)
    return path, int(obs.get["rows"])


def append_records(records: DataFrame, path: str, fmt: str = "parquet", batch: str | None = None) -> None:
    """Append rows to a record log (``save``/``saveAll`` of new rows).

    Rows appended under a ``batch`` name replace what an earlier attempt at the
    same batch wrote, so a job that runs again does not write them twice.
    """
    if batch is None:
        records.write.mode("append").format(fmt).save(path)
    else:
        records.write.mode("overwrite").format(fmt).save(f"{path}/batch={batch}")
