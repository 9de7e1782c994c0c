"""Benchmark decontamination by winnowing.

Texts become word k-gram hashes; of every run of neighbouring hashes the
smallest is kept, so two texts that share a window of words keep a common hash.
Documents and benchmark items are joined on the kept hashes; around a hit the
windows are compared word by word.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from railyard.llm.common import checkpointed, rows_with, sized

GRAM = 8
WINDOW = 10
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"      # before A-Z change case
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text) -> Column:
    """Words of a text column; only A-Z change case (``lower`` would change other letters too)."""
    t = F.coalesce(F.col(text), F.lit(""))
    low = F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))
    return F.array_remove(F.split(low, NOT_WORD), "")


def _upto(last: Column) -> Column:
    """0..last, or nothing when ``last`` is negative."""
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def _ahead(values: str, n: int) -> Column:
    return F.slice(values, n + 1, F.greatest(F.size(values) - n, F.lit(0)))


def _with_grams(frame: DataFrame, words: str, k: int) -> DataFrame:
    """``frame`` with column ``grams{k}``: the hash of the k words from each place, null near the end.

    Hashes of 1, 2, 4, ... words are combined pairwise, each array its own
    column, so that every array is made once a row.
    """
    def join(x, y):
        return F.when(y.isNotNull(), F.xxhash64(x, y))

    keep = frame.columns
    frame = frame.withColumn("part1", F.transform(words, lambda w: F.xxhash64(w)))
    size, done, got = 1, 0, None
    while done < k:
        if k & size:
            part = F.col(f"part{size}") if not done else F.zip_with(got, _ahead(f"part{size}", done), join)
            frame = frame.withColumn(f"done{size}", part)
            got, done = f"done{size}", done + size
        if done < k:
            frame = frame.withColumn(f"part{2 * size}", F.zip_with(f"part{size}", _ahead(f"part{size}", size), join))
            size *= 2
    return frame.select(*keep, F.col(got).alias(f"grams{k}"))


def _kept(frame: DataFrame, keep: list[str], window: int) -> DataFrame:
    """The winnowed hashes of ``frame``'s words, one row each."""
    k = min(GRAM, window)
    grams = _with_grams(frame, "words", k)
    g, run = F.col(f"grams{k}"), window - k + 1
    low = g
    if run > 1:
        def smallest(x, i):
            rest = [F.get(g, i + j) for j in range(1, run)]
            return F.when(rest[-1].isNotNull(), F.least(x, *rest))
        low = F.transform(g, smallest)
    return grams.select(*keep, F.explode(F.array_distinct(low)).alias("hash")).filter(F.col("hash").isNotNull())


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every row of ``docs``.

    A window is ``window`` consecutive words of an item, or all words of a
    shorter one; words of a document inside an occurrence of a window are hit.
    Null and empty texts have no words and no windows; an item without id
    marks words but is not counted; rows that repeat come out as often; an
    empty benchmark hits nothing; other columns are ignored.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.withColumn("mark", F.xxhash64("text"))
    items = checkpointed(benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(item_text_col).alias("words"))
                         .withColumn("m", F.least(F.size("words"), F.lit(window))).filter("m > 0"))
    lengths = sorted(r[0] for r in items.select("m").distinct().collect())      # at most ``window`` values
    words = d.select("doc_id", "mark", words_of("text").alias("words"))
    found = None
    for m in lengths:
        kept = sized(_kept(items.filter(F.col("m") == m), [], m).distinct(), "benchmark-hashes")
        hit = (_kept(words.select("mark", "words"), ["mark"], m).join(kept, "hash")
               .select("mark", F.struct(F.lit(m).alias("m"), F.col("hash")).alias("hit")))
        found = hit if found is None else found.unionByName(hit)
    base = d.select("doc_id", F.sha2("text", 256).alias("sha"), F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("n_words"))
    if found is None:
        marked = None
    else:
        hits = found.groupBy("mark").agg(F.collect_set("hit").alias("hits"))
        marked = _extend(d, sized(hits, "benchmark-hits"), items, lengths)
    if marked is None:
        out = base.withColumn("n_hit", F.lit(0).cast("bigint")).withColumn("items", F.array().cast("array<string>"))
    else:
        out = base.join(marked, "sha", "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size(listed).cast("bigint").alias("n_items"),
                      F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def _windows(words: Column, starts: Column, m: int) -> Column:
    return F.transform(starts, lambda p: F.struct(F.lit(m).alias("m"), p.alias("start"),
                                                  F.array_join(F.slice(words, p + 1, m), " ").alias("window")))


def _extend(d: DataFrame, hits: DataFrame, items: DataFrame, lengths: list[int]) -> DataFrame:
    """``sha, n_hit, items``: windows around the hits that occur in the benchmark, per distinct text."""
    hit = rows_with(d.select("mark", "text"), hits, "mark").join(hits, "mark")
    hit = hit.withColumn("sha", F.sha2("text", 256)).groupBy("sha").agg(F.first("text").alias("text"), F.first("hits").alias("hits"))
    hit = hit.select("sha", "hits", words_of("text").alias("words"))
    k_values = sorted({min(GRAM, m) for m in lengths})
    for k in k_values:
        hit = _with_grams(hit, "words", k)
    parts = []
    for m in lengths:
        k = min(GRAM, m)
        own = F.transform(F.filter("hits", lambda h: h["m"] == m), lambda h: h["hash"])
        at = F.filter(_upto(F.size("words") - k), lambda i: F.array_contains(F.col(f"own{m}"), F.get(F.col(f"grams{k}"), i)))
        near = F.transform(at, lambda i: F.sequence(F.greatest(i - (m - k), F.lit(0)), F.least(i, F.size("words") - m)))
        hit = hit.withColumn(f"own{m}", own)
        parts.append(F.when(F.size("words") >= m, _windows(F.col("words"), F.array_distinct(F.flatten(near)), m))
                      .otherwise(F.array().cast("array<struct<m:int,start:int,window:string>>")))
    opened = hit.select("sha", F.inline(F.concat(*parts) if len(parts) > 1 else parts[0]))
    known = items.select("item", "m", F.explode(F.transform(_upto(F.size("words") - F.col("m")),
                                                            lambda p: F.array_join(F.slice("words", p + 1, F.col("m")), " "))).alias("window"))
    known = known.groupBy("m", "window").agg(F.collect_set("item").alias("items"))
    occur = opened.join(known, ["m", "window"])
    span = F.sequence(F.col("start"), F.col("start") + F.col("m") - 1)
    return occur.groupBy("sha").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list(span)))).cast("bigint").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
