"""Tickets, bookings and payments stored in buckets of the booking, so that their joins need no exchange.

Tickets without a booking are a table of their own: in buckets of the booking
they would all be one bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from railyard.plans.report import booking_payments
from railyard.sources.stored import _fs
from railyard.sources.tables import DomainTables

# table -> (rows, bucket column)
LAYOUT = {
    "tickets_booked": ("tickets", "booking_id IS NOT NULL", "booking_id"),
    "tickets_unbooked": ("tickets", "booking_id IS NULL", None),
    "bookings": ("bookings", "true", "id"),
    "payments": ("payments", "booking_id IS NOT NULL", "booking_id"),
}


def write_bucketed(tables: DomainTables, root: str, buckets: int) -> None:
    """Write the tables of ``LAYOUT`` below ``root``; each bucket is one file, sorted by its key.

    Rows are dealt to the buckets before the write (the writer uses the same
    hash), so a task writes one file and not one per bucket.
    """
    for name, (source, rows, key) in LAYOUT.items():
        df = tables[source].filter(rows)
        if key:
            w = (df.repartition(buckets, key).write.mode("overwrite").format("parquet")
                   .bucketBy(buckets, key).sortBy(key).option("path", f"{root}/{name}"))
            spark = tables.spark
            spark.sql(f"DROP TABLE IF EXISTS {_table(root, name)}")
            w.saveAsTable(_table(root, name))
        else:
            df.write.mode("overwrite").parquet(f"{root}/{name}")


def _table(root: str, name: str) -> str:
    """Catalogue name of a stored table: of its folder's name, which a fingerprint makes unique."""
    folder = root.rstrip("/").rsplit("/", 1)[-1]
    return "".join(c if c.isalnum() else "_" for c in f"{name}_{folder}").lower()


def read_bucketed(spark: SparkSession, root: str, buckets: int) -> dict[str, DataFrame]:
    """The stored tables; a session whose catalogue does not know them registers the files that are there."""
    out = {}
    for name, (_, _, key) in LAYOUT.items():
        plain = spark.read.parquet(f"{root}/{name}")
        if key and not spark.catalog.tableExists(_table(root, name)):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
            spark.sql(f"CREATE TABLE {_table(root, name)} ({columns}) USING parquet "
                      f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{root}/{name}'")
        out[name] = spark.table(_table(root, name)) if key else plain
    return out


def stored_bucketed(tables: DomainTables, root: str, buckets: int) -> dict[str, DataFrame]:
    """``read_bucketed``, after writing what ``root`` does not hold yet."""
    done, fs = _fs(tables.spark, f"{root}/payments/_SUCCESS")
    if not fs.exists(done):
        write_bucketed(tables, root, buckets)
    return read_bucketed(tables.spark, root, buckets)


def tickets_with_bookings(stored: dict[str, DataFrame]) -> DataFrame:
    """All tickets with their booking's columns and payment summary (as the report joins them), without an
    exchange: payments are summed, bookings joined and tickets joined inside their buckets."""
    bp = booking_payments(stored["bookings"], stored["payments"])
    booked = stored["tickets_booked"]
    found = booked.join(bp, booked.booking_id == bp.b_id, "left").drop("b_id")
    return found.unionByName(stored["tickets_unbooked"], allowMissingColumns=True)


class BucketedDomain(DomainTables):
    """Domain tables whose tickets carry the booking side already (see ``ticket_report``)."""

    def __init__(self, base: DomainTables, root: str, buckets: int):
        super().__init__(base.spark)
        self.base, self.stored = base, stored_bucketed(base, root, buckets)

    def build(self, name):
        return tickets_with_bookings(self.stored) if name == "tickets" else self.base[name]
