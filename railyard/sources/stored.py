"""Domain tables written once to the shared folder and read back from Parquet.

Deriving a domain table (e.g. tickets from line items) is a whole-table
shuffle; a report should not repeat it on every run.  ``StoredDomain``
writes each table the first time it is asked for — under the cluster's
``spark.checkpoint.dir``, so any executor can read it and lineage is cut —
and serves later requests from the stored copy:

  * tickets are partitioned by ``issue_month`` (``yyyy-MM`` of ``issued_at``
    in the session zone), so a date window prunes partitions and pushes the
    exact ``issued_at`` range into the remaining files, which are written
    time-sorted so row-group statistics skip what the range excludes;
  * every writer has a folder of its own below the table's, and a copy is
    reused only if its ``_SUCCESS`` marker exists, so a write interrupted by
    a lost executor or driver is simply redone, and two jobs deriving the
    same table at once cannot mix their files (later readers take one copy);
  * the storage path carries a fingerprint of the source files (paths,
    sizes, modification times), so changed inputs are never served stale.
"""

from __future__ import annotations

import contextlib
import hashlib
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railyard.session import scratch_path
from railyard.sources.tables import DomainTables

# table -> (partition column, its expression, the column files are clustered by)
LAYOUT_VERSION = 4   # bump when the stored layout changes, so old copies are not reused

PARTITIONING = {"tickets": ("issue_month", lambda df: F.date_format("issued_at", "yyyy-MM"), "issued_at")}

# the tables of most rows are compressed further; those that joins may broadcast are not, for a broadcast is decided by file size
DENSE = ("tickets", "payments")


def _fs(spark, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fingerprint(spark, folder: str) -> str:
    """Hash of (path, size, mtime) of all files below ``folder``."""
    p, fs = _fs(spark, folder)
    items, found = [], fs.listFiles(p, True)
    while found.hasNext():
        s = found.next()
        items.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    items.sort()
    return hashlib.sha1(repr(items).encode()).hexdigest()[:16]


@contextlib.contextmanager
def _exchanges_dropped(spark):
    """Files of exchanges go as soon as what was run meanwhile has ended, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def write_table(df: DataFrame, name: str, path: str, columns=None, tasks: tuple = ()) -> None:
    """Write one domain table in the stored layout (see module doc).

    With ``columns`` the rows of ``df`` are what the table is computed from: they
    are put in order first, so that the exchange and the sort carry these few
    columns, and ``columns(rows, *kept)`` makes the table's after that.
    """
    if name in PARTITIONING:
        # Range-partition on time: each task covers a contiguous slice of
        # it, so a month gets a few large files (a busy month is split
        # across tasks by the sampled ranges), and rows are sorted by time
        # inside each file, which keeps row-group min/max tight for the
        # pushed issued_at range.  The month follows from the time and is
        # formed behind the exchange.
        col, expr, cluster = PARTITIONING[name]
        w = df.repartitionByRange(*tasks, cluster)
        w = w.withColumn(col, expr(w)).sortWithinPartitions(col, cluster)
        w = columns(w, col) if columns else w
        writer = w.write.partitionBy(col)
    else:
        writer = df.write
    if name in DENSE:
        writer = writer.option("compression", "zstd")
    with _exchanges_dropped(df.sparkSession):
        writer.mode("overwrite").parquet(path)


class StoredDomain(DomainTables):
    def __init__(self, source: DomainTables, root: str, extra: dict | None = None):
        super().__init__(source.spark)
        self.source = source
        self.root = root
        self.extra = extra or {}   # name -> callable returning a DataFrame (non-domain derived tables)

    def _stored(self, name: str) -> str | None:
        """The first complete copy of a table, by path."""
        pattern, fs = _fs(self.spark, f"{self.root}/{name}/*/_SUCCESS")
        found = sorted(s.getPath().getParent().toString() for s in fs.globStatus(pattern) or [])
        return found[0] if found else None

    def _derive(self, name: str) -> DataFrame:
        return self.extra[name]() if name in self.extra else self.source[name]

    def build(self, name: str) -> DataFrame:
        path = self._stored(name)
        if path is None:
            path = f"{self.root}/{name}/{uuid.uuid4().hex}"
            narrow = self.source.narrow(name) if name not in self.extra and hasattr(self.source, "narrow") else None
            if narrow:
                rows, columns, tasks = narrow
                write_table(rows, name, path, columns, tasks)
            else:
                write_table(self._derive(name), name, path)
        return self.spark.read.parquet(path)


def _code_version(obj) -> str:
    """Hash of the source of the derivation (so edited derivations never reuse old copies)."""
    import inspect
    import sys

    src = inspect.getsource(sys.modules[type(obj).__module__]) + inspect.getsource(sys.modules[__name__])
    return hashlib.sha1(src.encode()).hexdigest()[:8]


def stored_adapter(adapter, name: str = "domain") -> StoredDomain:
    """A ``StoredDomain`` over a ``StarAdapter``, placed in the shared folder.

    The folder name carries the layout version, a hash of the derivation code
    and a fingerprint of the input files."""
    spark = adapter.spark
    root = scratch_path(spark, f"{name}-v{LAYOUT_VERSION}-{_code_version(adapter)}-"
                               f"{fingerprint(spark, adapter.sf_dir)}")
    stored = StoredDomain(adapter, root, extra={"job_observations": adapter.job_observations})
    adapter.resolver = stored   # e.g. trips are derived from the stored tickets, not from line items again
    return stored
