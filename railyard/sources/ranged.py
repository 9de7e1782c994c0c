"""A keyed table in hash ranges, of which an upsert rewrites only those its keys fall into.

Rows lie in one Parquet partition per range (``_range``, a hash of the key), so a
batch of changes reads and writes the ranges of its keys and nothing else, by
dynamic partition overwrite.  The changes are derived once and kept; the merged
rows are staged, in the table's partitions, before any of these is replaced: a
writer that is lost while partitions are being replaced puts the whole staged
batch in place when it runs again, and a batch that is replayed changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from railyard.sources.stored import _fs

RANGE, BATCH, SHARE = "_range", "_batch", "_share"
# tasks that the rows of a range may be dealt to
SHARES = 8


class RangedTable:
    """``schema`` keyed by ``key`` below ``root``; ``ranges`` bounds the partitions (and what the driver lists)."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str, ranges: int = 64):
        self.spark, self.schema, self.key, self.ranges = spark, schema, key, ranges
        self.rows, self.changes, self.staged = f"{root}/rows", f"{root}/changes", f"{root}/staged"

    def _range(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.ranges)).cast("int")

    def _stored(self) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField(RANGE, T.IntegerType())])
        path, fs = _fs(self.spark, self.rows)
        if not fs.exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.rows)

    def read(self) -> DataFrame:
        return self._stored().drop(RANGE)

    def _dealt(self, df: DataFrame) -> DataFrame:
        """``df`` exchanged by range and share of it, so that all rows of a key meet."""
        share = F.pmod(F.xxhash64(F.col(self.key), F.lit(SHARES)), F.lit(SHARES)).cast("int")
        return df.withColumn(SHARE, share).repartition(RANGE, SHARE)

    def _put(self, df: DataFrame) -> None:
        """Replace the ranges that ``df``, read from partitions by range, has rows of."""
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(RANGE).parquet(self.rows)

    def create(self, df: DataFrame) -> None:
        """The whole table, in one write."""
        df = df.select(*self.schema.names).withColumn(RANGE, self._range())
        self._dealt(df).drop(SHARE).write.mode("overwrite").partitionBy(RANGE).parquet(self.rows)

    def _read_staged(self) -> DataFrame:
        rows = self.spark.read.parquet(self.staged)
        return rows.withColumn(RANGE, F.col(RANGE).cast("int"))

    def _staged_batch(self, batch: int):
        path, fs = _fs(self.spark, f"{self.staged}/_SUCCESS")
        if not fs.exists(path):
            return None
        rows = self._read_staged()
        return rows.drop(BATCH) if rows.filter(F.col(BATCH) == batch).limit(1).count() else None

    def upsert(self, changes: DataFrame, order: Column, batch: int = -1) -> list[int]:
        """Put ``changes`` in place: per key the row with the greatest ``order``, stored or new, stays; of equal
        ones the new.  Returns the ranges that were rewritten.  ``batch`` (not negative) makes a replay of the same
        number finish what a lost writer began."""
        schema = T.StructType([*self.schema.fields, T.StructField(RANGE, T.IntegerType())])
        staged = self._staged_batch(batch) if batch >= 0 else None
        if staged is None:
            changes.select(*self.schema.names).withColumn(RANGE, self._range()).write.mode("overwrite").parquet(self.changes)
            new = self.spark.read.schema(schema).parquet(self.changes).withColumn("_new", F.lit(1))
            touched = [r[0] for r in new.select(RANGE).distinct().collect()]
            if not touched:
                return []
            old = self._stored().filter(F.col(RANGE).isin(touched)).withColumn("_new", F.lit(0))
            row = F.struct(*self.schema.names)
            merged = self._dealt(old.unionByName(new)).groupBy(RANGE, SHARE, self.key).agg(F.max_by(row, F.struct(order, "_new")).alias("r"))
            merged = merged.select("r.*", RANGE, F.lit(batch).cast("long").alias(BATCH))
            merged.write.mode("overwrite").partitionBy(RANGE).parquet(self.staged)
            staged = self._read_staged().drop(BATCH)
        touched = [r[0] for r in staged.select(RANGE).distinct().collect()]
        self._put(staged)
        return sorted(touched)
