"""Helpers shared by the corpus operators."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from railyard.operators.arrivals import bloom, might_contain
from railyard.session import checkpoint_dir, scratch_path

# text handed to one Python call at a time; bounds a worker's memory
BLOCK_BYTES = 4 << 20
# narrow rows of a task; every task of an exchange leaves files of its own, however few its rows
ROWS = 20_000


def spread(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def block_count(df: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks of about ``block_bytes`` of text that ``df`` fills (one pass over lengths)."""
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, math.ceil(total / block_bytes))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tasks_for(rows: int) -> int:
    """Tasks that so many narrow rows (ids, labels) are worth, ``ROWS`` each."""
    return max(1, math.ceil(rows / ROWS))


def sized(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its measured size lets the planner broadcast it to a join
    with texts, or shuffle both sides, before the texts have moved."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def rows_with(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` may be among ``keys`` (written, so cheap to read): all that are, and few
    others.  A Bloom filter decides, so nothing of ``df`` moves; join the result to ``keys`` for the exact rows."""
    words, bits = bloom(keys, column)
    return df.filter(might_contain(words, bits, F.col(column)))


def rows_without(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` is not among ``keys``; only those that may be are joined to them."""
    words, bits = bloom(keys, column)
    may = F.coalesce(might_contain(words, bits, F.col(column)), F.lit(False))
    return df.filter(~may).unionByName(df.filter(may).join(keys.select(column), column, "left_anti").select(*df.columns))


def binary_values(col: pa.Array) -> list[bytes]:
    """A string column of a batch as bytes, null as empty."""
    return [v or b"" for v in col.cast(pa.binary()).to_pylist()]


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node that has an edge.

    ``edges`` has two columns of one comparable type.  Alternates the large-star
    and small-star steps, which keep the components and turn them into stars in
    a logarithmic number of rounds; each round is two aggregations and two
    joins, in as many tasks as its edges are worth, and its edges are
    checkpointed.  Returns ``node, component``; no
    edges give an empty frame.
    """
    a, b = edges.columns
    e = (edges.filter(F.col(a) != F.col(b))
              .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    e = checkpointed(e)
    seen = None
    while True:
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == seen or now[0] == 0:
            e = e.coalesce(tasks_for(now[0]))
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct().coalesce(tasks_for(now[0])))
        seen, tasks = now, tasks_for(now[0])
        e = e.coalesce(tasks)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks)
        large = (both.filter("v > u").join(low, "u").coalesce(tasks)
                     .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(tasks))
        low = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
        small = large.join(low, "u").coalesce(tasks)
        e = checkpointed(small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                         .unionByName(low.select("u", F.col("m").alias("v"))).distinct().coalesce(tasks))


# ---------------------------------------------------------------------------
# rolling hashes over a buffer of concatenated texts
# ---------------------------------------------------------------------------
def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


_BYTE = _mixed(_mixed(np.arange(1, 257, dtype=np.uint64)))


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of each ``k``-byte string of ``data``, by doubling; ``len - k + 1`` values."""
    n = len(data) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h, size, out, done = _BYTE[data], 1, None, 0
    while True:
        if k & size:
            part = h[done:done + n]
            out = part.copy() if out is None else _mixed(out + (part ^ (part >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93))
            done += size
        if done == k:
            return _mixed(out)
        h = _mixed(h[:-size] + (h[size:] ^ (h[size:] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9))
        size *= 2


def window_minima(keys: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of ``w`` consecutive keys."""
    n = len(keys) - w + 1
    if n <= 0:
        return np.empty(0, keys.dtype)
    m, size = keys, 1
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[:n], m[w - size:w - size + n])
