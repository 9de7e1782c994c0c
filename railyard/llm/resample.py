"""Importance resampling of documents towards a target distribution.

Hashed runs of words are counted over all source and all target texts; a
bucket's gain is the logarithm of how much likelier the target makes it.  A
document's weight is the mean gain of its runs, Gumbel noise from a hash of its
id turns weights into a sample without replacement, and the highest scores are
drawn.

Texts are read in Arrow batches and never shuffled: words come from
``ascii_lower``, ``split_pattern_regex`` and ``list_flatten``, are coded by
``dictionary_encode``, and longer runs are pairs of shifted codes, so a CRC is
taken once per distinct run of a slice.  Gains are looked up with ``take`` and
summed by row.  What travels is one row per document and, per task, one count
per bucket.  The rank comes from a histogram of scores, not from a global sort.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from railyard.llm.common import checkpointed
from railyard.llm.words import slices, words

# a-z, 0-9 and everything beyond ASCII are word characters (A-Z are lower-cased before)
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# scores that one row of the outer histogram covers
CELL = 512


def _buckets(texts: pa.Array, runs: int, buckets: int):
    """Bucket and row of every run of 1 to ``runs`` words, as parts by run length; and words per row."""
    w = words(texts, SEPARATORS)
    word_crc = [zlib.crc32(x) for x in w.dictionary]
    parts = []
    code, crc, row = w.code, word_crc, w.row
    for length in range(1, runs + 1):
        if length > 1:
            # a run is the run one word shorter and the word behind it, both in the same row
            behind, same = w.code[length - 1:], w.row[length - 1:] == w.row[:len(w.row) - length + 1]
            start = np.flatnonzero(same)
            whole = code[np.searchsorted(kept, start)] * max(1, len(w.dictionary)) + behind[start]
            pairs = pa.array(whole).dictionary_encode()
            short, last = np.divmod(pairs.dictionary.to_numpy(), max(1, len(w.dictionary)))
            spaced = [zlib.crc32(b" ", c) for c in crc]
            crc = [zlib.crc32(w.dictionary[j], spaced[i]) for i, j in zip(short.tolist(), last.tolist())]
            code, row = pairs.indices.to_numpy(zero_copy_only=False).astype(np.int64), w.row[start]
            kept = start
        else:
            kept = np.arange(len(code))
        of_code = np.array(crc, np.int64) % buckets
        parts.append((of_code.take(code), row))
    return parts, np.bincount(w.row, minlength=w.rows)


def _counts(runs: int, buckets: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for s in slices(b, 0):
                for bucket, _ in _buckets(s.column(0), runs, buckets)[0]:
                    total += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])
    return run


def bucket_counts(texts: DataFrame, text_col: str, runs: int, buckets: int) -> DataFrame:
    """``bucket, n`` over all texts; each task adds up its own counts before the shuffle."""
    part = texts.select(F.col(text_col).cast("string")).mapInArrow(_counts(runs, buckets), "bucket bigint, n bigint")
    return part.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """``bucket, gain`` of every bucket, in thousandths, from the counts of both sides."""
    both = source.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    both = (both.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
                .select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")))
    total = both.agg(F.sum("s").alias("S"), F.sum("t").alias("T"))
    S, T = (total.select(c).scalar().cast("double") for c in ("S", "T"))
    ratio = ((F.col("t") + 1) * (S + buckets)) / ((F.col("s") + 1) * (T + buckets))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).cast("long").alias("gain"))


def _document_gains(runs: int, gain: np.ndarray):
    def run(batches):
        for b in batches:
            for s in slices(b, 1):
                parts, n_words = _buckets(s.column(1), runs, len(gain))
                n, total = np.zeros(s.num_rows, np.int64), np.zeros(s.num_rows, np.int64)
                for bucket, row in parts:
                    if len(row):
                        starts = np.flatnonzero(np.diff(row, prepend=-1))
                        total[row[starts]] += np.add.reduceat(gain.take(bucket), starts)
                        n += np.bincount(row, minlength=s.num_rows)
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(n_words), pa.array(n), pa.array(total)],
                                                 names=["row", "n_words", "n_features", "total"])
    return run


def _noise(id_col: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of a hash of the id; a null id hashes as empty."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def scores(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 2,
           buckets: int = 10_000, seed: int = 7, carry: list[str] | None = None) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every row, ``carried`` holding the columns ``carry``."""
    table = gains(bucket_counts(docs, text_col, runs, buckets), bucket_counts(target, text_col, runs, buckets), buckets)
    # one number per bucket: bounded by the parameter, whatever the corpus
    gain = np.array([r.gain for r in table.orderBy("bucket").collect()], np.int64)
    row = F.struct(F.col(id_col).alias("id"), F.struct(*[F.col(c) for c in carry]).alias("carried")) if carry else F.struct(F.col(id_col).alias("id"))
    d = docs.select(row.alias("row"), F.col(text_col).cast("string").alias("t"))
    found = d.mapInArrow(_document_gains(runs, gain),
                         f"row {d.schema['row'].dataType.simpleString()}, n_words bigint, n_features bigint, total bigint")
    weight = F.expr("CASE WHEN n_features = 0 THEN 0L ELSE (total - pmod(total, n_features)) div n_features END")
    found = found.select(F.col("row.id").alias("doc_id"), "n_words", "n_features", weight.alias("weight"),
                         *([F.col("row.carried").alias("carried")] if carry else []))
    return found.withColumn("score", F.col("weight") + _noise(F.col("doc_id"), seed))


def ranked(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3 ... over the drawn rows, null for the others.

    Scores are whole numbers within a range set by their formula, so a histogram
    of them stays small; its outer cells (a few hundred) are summed in one
    window, the scores of a cell in another, and only rows that tie on a score
    are numbered together.
    """
    able = scored.filter(F.col("n_words") >= least_words)
    hist = able.groupBy("score").agg(F.count("*").alias("n")).withColumn("cell", F.expr(f"score - pmod(score, {CELL})"))
    cells = hist.groupBy("cell").agg(F.sum("n").alias("n"))
    above = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("cell", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("above"),
                         F.expr(f"(sum(n) over () * {int(percent)}) div 100").alias("draw"))
    within = Window.partitionBy("cell").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    before = (hist.join(cells, "cell")
                  .select("score", "draw", (F.col("above") + F.coalesce(F.sum(hist["n"]).over(within), F.lit(0))).alias("before")))
    before = before.filter("before < draw")
    rest = scored.filter(~F.coalesce(F.col("n_words") >= least_words, F.lit(False))).unionByName(able.join(before.select("score"), "score", "left_anti"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("score").orderBy(
        F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")))
    drawn = able.join(before, "score").withColumn("place", place)
    drawn = drawn.select(*scored.columns, F.when(F.col("place") <= F.col("draw"), F.col("place")).cast("long").alias("rank"))
    return drawn.unionByName(rest.select(*scored.columns, F.lit(None).cast("long").alias("rank")))


def importance_resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 2,
                        buckets: int = 10_000, percent: int = 25, least_words: int = 20, seed: int = 7,
                        carry: list[str] | None = None) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` for every row of ``docs``; columns named in ``carry``
    come along as the struct ``carried`` (``rank`` not null: the resampled corpus).

    A null or empty text has no words, weight 0 and is never drawn with ``least_words`` above 0.  A null id takes
    the noise of the empty id and stands behind others of its score.  Repeated rows are scored alike and each
    takes a rank of its own.  Very long texts are worked on alone.  An empty ``docs`` gives an empty frame, an empty
    ``target`` gains from no counts.  Other columns are ignored, whatever their names.
    """
    return ranked(checkpointed(scores(docs, target, id_col, text_col, runs, buckets, seed, carry)), percent, least_words)


def resampled(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows with the columns of ``docs``."""
    found = importance_resample(docs, target, carry=docs.columns, **options)
    return found.filter("rank IS NOT NULL").select(*[F.col("carried")[c].alias(c) for c in docs.columns])
