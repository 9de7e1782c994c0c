"""Keys and references of an arriving batch, checked against stored tables that are not shuffled.

The database checks each insert against an index.  Here the batch's keys become
a Bloom filter — a few megabytes of bits, counted together by partial
aggregation — and the stored table is scanned through it: only rows that may
match are exchanged and then joined exactly, so false positives cost a row
and change nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from railyard import schemas

# bits per key, and the limits of a filter's size in bits (1 KB to 8 MB)
BITS_PER_KEY, LEAST_BITS, MOST_BITS = 16, 1 << 13, 1 << 26
HASHES = 5


def _positions(key: Column, bits: int) -> list[Column]:
    a, b = (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(bits)) for seed in (1, 2))
    return [F.pmod(a + F.lit(i) * b, F.lit(bits)) for i in range(HASHES)]


def key_text(columns: list[str]) -> Column:
    """One value per key: its columns as a JSON text, NULL if any of them is."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return F.when(whole, F.to_json(F.array(*[F.col(c).cast("string") for c in columns])))


def bloom(keys: DataFrame, column: str) -> tuple[Column, int]:
    """A filter over ``column`` of ``keys`` as a one-row scalar, and its number of bits.

    The size follows the number of keys up to ``MOST_BITS``; beyond that more rows pass, none is lost.
    """
    n = keys.select(F.approx_count_distinct(column)).first()[0] or 0
    bits = LEAST_BITS
    while bits < min(n * BITS_PER_KEY, MOST_BITS):
        bits *= 2
    at = keys.select(F.explode(F.array(*_positions(F.col(column), bits))).alias("p"))
    words = at.groupBy((F.shiftright("p", 6)).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))).alias("set"))
    # every word of the filter, in order: at most MOST_BITS / 64 rows
    every = keys.sparkSession.range(bits // 64).withColumnRenamed("id", "word").join(words, "word", "left")
    row = every.agg(F.array_sort(F.collect_list(F.struct("word", F.coalesce("set", F.lit(0).cast("long")).alias("set")))).alias("w"))
    return row.select(F.col("w.set")).scalar(), bits


def might_contain(words: Column, bits: int, key: Column) -> Column:
    """False only for keys that are surely not in the filter."""
    on = [F.call_function("shiftright", F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
          for p in _positions(key, bits)]
    return reduce(lambda a, b: a & b, on)


def _may_match(stored: DataFrame, columns: list[str], keys: DataFrame) -> DataFrame:
    """Keys of ``stored`` (column ``key``) that the filter over ``keys`` lets through."""
    words, bits = bloom(keys, "key")
    k = stored.select(key_text(columns).alias("key")).filter(F.col("key").isNotNull())
    return k.filter(might_contain(words, bits, F.col("key")))


def arriving_duplicates(stored: DataFrame, batch: DataFrame, table: str, key_sets=None) -> DataFrame:
    """Keys of ``batch`` that occur again, in it or in ``stored`` (H1 on insert):
    ``table_name, key_columns, key_value, n_batch, n_stored``.  Keys with a NULL are not compared."""
    frames = []
    for columns in key_sets or [("id",), *schemas.UNIQUE.get(table, [])]:
        columns = list(columns)
        new = batch.select(key_text(columns).alias("key")).filter(F.col("key").isNotNull()).groupBy("key").agg(F.count("*").alias("n_batch"))
        old = _may_match(stored, columns, new).groupBy("key").agg(F.count("*").alias("n_stored"))
        met = new.join(old, "key", "left").withColumn("n_stored", F.coalesce("n_stored", F.lit(0)))
        frames.append(met.filter("n_batch + n_stored > 1").select(
            F.lit(table).alias("table_name"), F.lit(",".join(columns)).alias("key_columns"), F.col("key").alias("key_value"), "n_batch", "n_stored"))
    return reduce(DataFrame.unionByName, frames)


def arriving_orphans(parent: DataFrame, batch: DataFrame, fk: schemas.ForeignKey, arriving_parents: DataFrame | None = None) -> DataFrame:
    """References of ``batch`` that neither ``parent`` nor the parents arriving with it have (H3 on insert):
    ``table_name, column_name, parent_table, key_value, n_rows``."""
    refs = batch.select(key_text([fk.column]).alias("key")).filter(F.col("key").isNotNull()).groupBy("key").agg(F.count("*").alias("n_rows"))
    there = _may_match(parent, ["id"], refs)
    if arriving_parents is not None:
        there = there.unionByName(arriving_parents.select(key_text(["id"]).alias("key")))
    return refs.join(there.distinct(), "key", "left_anti").select(
        F.lit(fk.child).alias("table_name"), F.lit(fk.column).alias("column_name"), F.lit(fk.parent).alias("parent_table"),
        F.col("key").alias("key_value"), "n_rows")
