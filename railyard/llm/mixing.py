"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight curve over training time 0..1.  Its integral is the
source's weight; weights share out the words of the mix, and no source gives
more than ``max_repeats`` times its own words (the rest is shared out again).
A source's documents, in a seeded order and repeated as needed, meet a
cumulative word demand; inverting the integrated curve at the words before a
document gives the time at which it is read, and documents are range-sorted by
that time.  DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from railyard.llm.common import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
# documents of one (source, cell) that are put in order together
CELL_ROWS = 20_000


def word_count(text) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def _curve(points) -> Column:
    """A curve as an array of straight pieces: start time and weight, slope, area before and after."""
    if points[0][0] != 0 or points[-1][0] != 1 or any(w < 0 for _, w in points):
        raise ValueError("a weight curve runs from time 0 to time 1 and is not negative")
    area, pieces = 0.0, []
    for (t0, w0), (t1, w1) in zip(points, points[1:]):
        after = area + (w0 + w1) / 2 * (t1 - t0)
        pieces.append(F.struct(*(F.lit(float(v)).alias(n) for n, v in
                                 (("t", t0), ("w", w0), ("slope", (w1 - w0) / (t1 - t0)), ("before", area), ("after", after)))))
        area = after
    return F.array(*pieces)


def source_targets(sizes: DataFrame, curves, max_repeats: float = 3, share: float = 1.0) -> DataFrame:
    """``source, source_size, target, curve`` of each source in ``sizes`` (source, source_size).

    Sources in ascending code-point order, null last, get the curves in turn.
    The common level of words per weight is the largest of the levels that
    arise when sources reach their limit one after another, least headroom
    first.
    """
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    curve = F.element_at(F.array(*map(_curve, curves)), F.pmod(F.row_number().over(turn) - 1, F.lit(len(curves))) + 1)
    s = (sizes.withColumn("curve", curve)
              .withColumn("weight", F.element_at("curve", -1)["after"])
              .withColumn("limit", F.col("source_size") * F.lit(float(max_repeats))))
    fill = Window.orderBy(F.when(F.col("weight") > 0, F.col("limit") / F.col("weight")).asc_nulls_last(),
                          F.col("source").asc_nulls_last())
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = F.coalesce(F.sum("limit").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(every) * F.lit(float(share))
    s = s.withColumn("level", F.when(weight_left > 0, (total - filled) / weight_left).otherwise(F.lit(0.0)))
    level = F.max("level").over(every)
    return s.select("source", "source_size", "curve", "weight",
                    F.least("limit", F.greatest(level, F.lit(0.0)) * F.col("weight")).alias("target"))


def _time(curve: Column, area: Column) -> Column:
    """When a curve has accumulated ``area``."""
    piece = F.element_at(F.filter(curve, lambda p: p["after"] > area), 1)
    rest = area - piece["before"]
    root = F.sqrt(F.greatest(piece["w"] * piece["w"] + F.lit(2.0) * piece["slope"] * rest, F.lit(0.0)))
    return piece["t"] + F.when(rest > 0, F.lit(2.0) * rest / (piece["w"] + root)).otherwise(F.lit(0.0))


def curriculum_mix(docs: DataFrame, curves, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                   max_repeats: int = 3, share: float = 1.0, seed: str = "mix") -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, positions`` of every row of ``docs``.

    ``taken`` counts the words the mix takes from a document over all repeats;
    the last document that a source needs is cut where its demand ends, so a
    source's taken words are its target without fraction.  ``positions`` are
    the training times of its repeats (empty if none).  Rows that repeat an id
    stand side by side in the order, smaller first; null text has no words; a
    null id and a null source are values like others; no rows give no rows.
    """
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = checkpointed(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                                    word_count(text_col).alias("size"), key.alias("key")))
    cells = 1 << max(0, math.ceil(math.log2(max(1, rows.count() / CELL_ROWS))))
    rows = rows.withColumn("cell", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint") * F.lit(cells) / F.lit(1 << 32)))
    cell = rows.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    targets = source_targets(cell.groupBy("source").agg(F.sum("cell_size").alias("source_size")), curves, max_repeats, share)
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cell = cell.select("source", "cell", F.coalesce(F.sum("cell_size").over(before), F.lit(0)).alias("cell_begin"))
    cell = cell.alias("c").join(targets.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).select("c.*", "source_size", "target", "weight", "curve")
    inside = Window.partitionBy("source", "cell").orderBy("key", "size", F.col("doc_id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = (rows.alias("r").join(cell.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source")) & (F.col("r.cell") == F.col("c.cell")))
                .select("r.doc_id", "r.source", "size", "source_size", "target", "weight", "curve",
                        (F.col("cell_begin") + F.col("ahead")).alias("begin")))
    words = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    rest = words - whole * F.col("source_size")
    rows = rows.withColumn("whole", whole).withColumn("rest", rest)
    taken = F.col("whole") * F.col("size") + F.least("size", F.greatest(F.col("rest") - F.col("begin"), F.lit(0)))
    repeats = F.col("whole") + F.when(F.col("rest") > F.col("begin"), 1).otherwise(0)
    read_at = F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(repeats - 1, F.lit(0))),
                          lambda e: _time(F.col("curve"), (e * F.col("source_size") + F.col("begin")) / F.col("target") * F.col("weight")))
    positions = F.when((F.col("size") > 0) & (repeats > 0), read_at).otherwise(F.array().cast("array<double>"))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("bigint").alias("taken"), positions.alias("positions"))


def in_training_order(mixed: DataFrame) -> DataFrame:
    """One row per reading of a document, range-sorted by training time."""
    return (mixed.withColumn("position", F.explode("positions")).drop("positions")
                 .orderBy("position", "doc_id"))
