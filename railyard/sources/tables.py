"""Domain-table access.

Operators take a ``DomainTables`` (``tables["tickets"]`` → DataFrame) so the
same plan runs over stored domain tables (``ParquetDomain``), or over tables
derived on the fly from the shared test data (``StarAdapter``).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from railyard import schemas


# rows that a task of an exchange sorts or aggregates at a time without spilling
ROWS_A_TASK = 1_000_000


def tasks_for(spark: SparkSession, rows: int) -> tuple[int, ...]:
    """Number of tasks to exchange ``rows`` by, as arguments of ``repartition``; none if the session's number does,
    which adaptive execution may then lower."""
    least = -(-rows // ROWS_A_TASK)
    return (least,) if least > int(spark.conf.get("spark.sql.shuffle.partitions")) else ()


class DomainTables:
    """Lazy, memoised mapping from domain table name to DataFrame."""

    names = tuple(schemas.TABLES)
    rereadable = True   # a table read twice in a job gives the same rows

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._memo: dict[str, DataFrame] = {}

    def build(self, name: str) -> DataFrame:  # pragma: no cover - abstract
        raise NotImplementedError

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._memo:
            self._memo[name] = self.build(name)
        return self._memo[name]

    def with_overrides(self, **frames: DataFrame) -> "DomainTables":
        """A view of these tables with some replaced (e.g. after a delete or an upsert)."""
        return _Overridden(self, frames)


class _Overridden(DomainTables):
    def __init__(self, base: DomainTables, frames: dict[str, DataFrame]):
        super().__init__(base.spark)
        self._base, self._frames = base, frames
        self.rereadable = base.rereadable

    def build(self, name):
        return self._frames[name] if name in self._frames else self._base[name]


class ParquetDomain(DomainTables):
    """Stored domain tables: one Parquet dataset per table under ``root``.

    Reads use the declared schema (no inference); filters and projections reach
    the scan, and a tickets dataset partitioned by ``issue_month`` gets
    partition pruning for month windows.
    """

    def __init__(self, spark: SparkSession, root: str, declared_schema: bool = False):
        super().__init__(spark)
        self.root = root
        self.declared_schema = declared_schema

    def build(self, name):
        reader = self.spark.read
        if self.declared_schema:
            reader = reader.schema(schemas.schema(name))
        return reader.parquet(os.path.join(self.root, name))


class JdbcDomain(DomainTables):
    """Domain tables read from the operational database over JDBC.

    ``partitioning`` maps a table to ``(column, lower, upper, n)`` so the read
    is split into ``n`` range queries run by the executors in parallel —
    instead of one connection fetching every row.  (Needs a reachable
    database and its JDBC driver on the classpath; not exercised in tests.)
    """

    rereadable = False   # rows may change between two reads

    def __init__(self, spark: SparkSession, url: str, properties: dict | None = None,
                 partitioning: dict | None = None, fetch_size: int = 10000):
        super().__init__(spark)
        self.url, self.properties = url, dict(properties or {})
        self.partitioning = partitioning or {}
        self.fetch_size = fetch_size

    def build(self, name):
        r = (self.spark.read.format("jdbc").option("url", self.url).option("dbtable", name)
             .option("fetchsize", self.fetch_size).options(**self.properties))
        if name in self.partitioning:
            col, lo, hi, n = self.partitioning[name]
            r = (r.option("partitionColumn", col).option("lowerBound", lo)
                  .option("upperBound", hi).option("numPartitions", n))
        return r.load()


def write_domain(tables: DomainTables, root: str, names=None) -> None:
    """Materialise domain tables as Parquet in the stored layout (tickets
    partitioned by issue month and clustered by issue time)."""
    from railyard.sources.stored import write_table

    for name in names or tables.names:
        write_table(tables[name], name, os.path.join(root, name))
