"""Licence scan: sparse TF-IDF cosine of lines, paragraphs, comments and whole files to licence templates, then inheritance along paths.

Terms weigh by their document frequency over all files.  A unit of text is
compared only if it has one of the templates' rarest terms: the terms left out
weigh too little to reach the threshold without them, so no match is lost.  A
file without a licence of its own takes that of the licence file in its
nearest ancestor directory.  DataFrame functions only.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window, functions as F

from railyard.llm.common import checkpointed, rows_with
from railyard.llm.licence_templates import spdx_ids, templates

TERM = "[a-z0-9]+"
THRESHOLD = 0.75
# comments as one unit each: delimited ones, and runs of lines with a leader
COMMENT = r"""(/\*[\s\S]*?\*/|<!--[\s\S]*?-->|\"{3}[\s\S]*?\"{3}|'{3}[\s\S]*?'{3}|(?m:^[ \t]*+(?://|#|--|;|%)[^\n]*+\n?+)++)"""
SPDX = r"(?i)SPDX-License-Identifier:[ \t]*([^\n]*)"


def _idf(n, df):
    return math.log((1 + n) / (1 + df)) + 1


@lru_cache
def _terms() -> dict[str, Counter]:
    """Terms of every template; its name is the licence and a number."""
    return {f"{name}#{i}": Counter(re.findall(TERM, text.lower())) for i, (name, text) in enumerate(templates())}


def vocabulary() -> list[str]:
    return sorted(set().union(*_terms().values()))


def template_weights(files: int = 0, df: dict[str, int] | None = None) -> tuple[list[tuple[str, str, float]], float]:
    """``(template, term, weight)`` with unit length per template, and the idf of a term that no file has.

    ``df`` counts the files of the corpus that have a term.  A term weighs one
    plus the logarithm of its count, times its idf.
    """
    df, rows = df or {}, []
    for name, c in _terms().items():
        w = {t: (1 + math.log(k)) * _idf(files, df.get(t, 0)) for t, k in c.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        rows += [(name, t, x / norm) for t, x in sorted(w.items())]
    return rows, _idf(files, 0)


@lru_cache(maxsize=4)
def key_terms(threshold: float = THRESHOLD, files: int = 0, df: tuple[tuple[str, int], ...] = ()) -> list[str]:
    """Terms one of which every text at or over the threshold has.

    Of each template, the terms that most files of the corpus have are left
    out as long as all that is left out stays under the threshold by itself.
    """
    df, by = dict(df), {}
    for name, term, w in template_weights(files, df)[0]:
        by.setdefault(name, []).append((-df.get(term, 0), w, term))
    out = set()
    for ws in by.values():
        left = 0.0
        for _, w, term in sorted(ws):
            left += w * w
            if left >= threshold * threshold - 1e-9:
                out.add(term)
    return sorted(out)


def terms_of(text) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def units(text) -> Column:
    """What is compared of a text: its lines, its paragraphs (between lines without a term), its comments, and all of it."""
    return F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, r"\n(?:[^A-Za-z0-9\n]*+\n)++"),
                                     F.regexp_extract_all(text, F.lit(COMMENT), F.lit(1)), F.array(text)))


def licence_lines(texts: DataFrame, key: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """``key, licence, similarity``: the best template of every key (ties: first licence id) at or over the threshold.

    ``key`` tells texts apart; rows that share it are files with the same text.
    Each counts in the document frequencies, and the text is compared once.
    """
    spark = texts.sparkSession
    files = texts.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # template terms are constants of this package
    vocab = ", ".join(f"'{t}'" for t in vocabulary())
    n = files.count()
    df = dict(files.select(F.array_distinct(terms_of("text")).alias("terms"))
                   .select(F.explode(F.expr(f"filter(terms, t -> t in ({vocab}))")).alias("term")).groupBy("term").agg(F.count("*")).collect())
    weights, _ = template_weights(n, df)
    of_term = {}
    for name, t, w in weights:
        of_term.setdefault(t, []).append((name, w))
    known = spark.createDataFrame([(t, _idf(n, df.get(t, 0)), of_term[t]) for t in vocabulary()],
                                  "term string, idf double, templates array<struct<template:string,weight:double>>")
    keys = ", ".join(f"'{t}'" for t in key_terms(threshold, n, tuple(df.items())))
    has_key = F.expr(f"exists(terms, t -> t in ({keys}))")

    texts_near = checkpointed(files.withColumn("terms", terms_of("text")).filter(has_key).select("key", "text").dropDuplicates(["key"]))

    def candidates(of):
        found = of.select("key", F.explode(units(F.col("text"))).alias("unit")).withColumn("terms", terms_of("unit")).filter(has_key)
        return found.withColumn("unit", F.sha2(F.array_join("terms", " "), 256))

    # terms of no template weigh one at least: what stays under the threshold with that stays under it
    near = checkpointed(candidates(texts_near).select("key", "unit", F.expr(f"filter(terms, t -> t in ({vocab}))").alias("known"),
                                                 F.expr(f"size(array_distinct(filter(terms, t -> t not in ({vocab}))))").alias("others")))
    # one exchange by unit serves the counts, the lengths and the products: a unit's length stands under the template ""
    own = (near.select("unit", "known", "others").dropDuplicates(["unit"]).select("unit", "others", F.explode("known").alias("term"))
               .groupBy("unit", "others", "term").agg(F.count("*").alias("n"))
               .join(F.broadcast(known), "term").select("unit", "others", ((1 + F.log("n")) * F.col("idf")).alias("w"), "templates"))
    itself = F.array(F.struct(F.lit("").alias("template"), F.col("w").alias("weight")))
    sums = (own.select("unit", "others", "w", F.explode(F.concat(itself, "templates")).alias("t"))
               .groupBy("unit", "others", F.col("t.template").alias("template")).agg(F.sum(F.col("w") * F.col("t.weight")).alias("dot")))
    square = F.max(F.when(F.col("template") == "", F.col("dot"))).over(Window.partitionBy("unit", "others"))
    able = sums.withColumn("square", square).filter("template != ''").select("unit", "template", "dot", "square", "others")
    able = checkpointed(able.filter(F.col("dot") >= (threshold - 1e-6) * F.sqrt(F.col("square") + F.col("others"))))
    # the other terms of what is left, and their document frequencies over all files
    left = checkpointed(near.join(able.select("unit").distinct(), "unit", "left_semi").select("key", "unit"))
    # the texts stay where they are; of a text that the filter lets through, only units of another one can be left
    some = rows_with(texts_near, left, "key")
    rest = (rows_with(candidates(some), able, "unit").join(able.select("unit").distinct(), "unit", "left_semi").select("unit", "terms").dropDuplicates(["unit"])
                .select("unit", F.explode(F.expr(f"filter(terms, t -> t not in ({vocab}))")).alias("term")).groupBy("unit", "term").agg(F.count("*").alias("n")))
    rest = checkpointed(rest)
    # terms in no bucket of a wanted one need no exchange; there are 65,536 buckets at most
    bucket = F.pmod(F.xxhash64("term"), F.lit(1 << 16)).alias("bucket")
    frequency = (files.select(F.explode(F.array_distinct(terms_of("text"))).alias("term")).select("term", bucket)
                      .join(F.broadcast(rest.select(bucket).distinct()), "bucket", "left_semi").groupBy("term").agg(F.count("*").alias("df")))
    w = (1 + F.log("n")) * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1)
    more = rest.join(frequency, "term").select("unit", w.alias("w")).groupBy("unit").agg(F.sum(F.col("w") * F.col("w")).alias("more"))
    cosine = F.col("dot") / F.sqrt(F.col("square") + F.coalesce("more", F.lit(0.0)))
    alike = (able.join(more, "unit", "left").withColumn("similarity", F.round(cosine, 6)).filter(F.col("similarity") >= threshold)
                 .select("unit", F.substring_index("template", "#", 1).alias("licence"), "similarity"))
    first = F.min(F.struct((-F.col("similarity")).alias("s"), "licence")).alias("b")
    found = left.join(alike.groupBy("unit").agg(first), "unit").select("key", "b.licence", (-F.col("b.s")).alias("similarity"))
    # an identifier of an SPDX tag is one term
    ids = spark.createDataFrame(sorted(spdx_ids().items()), "id string, licence string")
    tags = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(SPDX), F.lit(1)), lambda t: F.split(F.lower(t), r"[^a-z0-9.+-]+")))
    tagged = (files.filter(F.col("text").rlike(SPDX)).dropDuplicates(["key"]).select("key", F.explode(tags).alias("id"))
                   .join(F.broadcast(ids), "id").select("key", "licence", F.lit(1.0).alias("similarity")))
    best = found.unionByName(tagged).groupBy("key").agg(first)
    return best.select("key", F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("similarity"))


def parent(path) -> Column:
    return F.regexp_replace(F.col(path), "/?[^/]*$", "")


def licence_scan(files: DataFrame, path_col: str = "path", text_col: str = "text", id_col: str = "doc_id",
                 licence_file: str = r"(?i)(^|/)(licen[cs]e|copying)(\.[a-z]+)?$", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, path, licence, similarity, origin, origin_path`` of every row of ``files``.

    ``origin`` is ``own`` if a line, paragraph, comment or all of the text reaches a template, else
    ``inherited`` if a licence file in the nearest ancestor directory (its own
    first) does, else null.  Of several licence files in a directory the one
    most alike counts, then the first path.  Null and empty texts match
    nothing; a null path inherits nothing; repeated rows come out as often;
    other columns are ignored.
    """
    f = files.select(F.col(id_col).alias("doc_id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    # equal texts match alike: each is compared once
    f = f.withColumn("key", F.sha2(F.coalesce("text", F.lit("")), 256))
    found = checkpointed(licence_lines(f, "key", "text", threshold))
    rows = f.select("doc_id", "path", "key").join(found, "key", "left")
    givers = (rows.filter(F.col("licence").isNotNull() & F.col("path").rlike(licence_file))
                  .groupBy(parent("path").alias("above"))
                  .agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("path").alias("p"), F.col("licence").alias("l"))).alias("g")))
    dirs = f.select(parent("path").alias("dir")).filter(F.col("dir").isNotNull()).distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("depth", "above"))
    nearest = above.join(givers, "above").groupBy("dir").agg(F.max_by("g", "depth").alias("g"))
    out = rows.withColumn("dir", parent("path")).join(nearest, "dir", "left")
    own, given = F.col("licence").isNotNull(), F.col("g").isNotNull()
    return out.select("doc_id", "path", F.coalesce("licence", "g.l").alias("licence"),
                      F.coalesce("similarity", -F.col("g.s")).alias("similarity"),
                      F.when(own, F.lit("own")).when(given, F.lit("inherited")).alias("origin"),
                      F.when(own, F.col("path")).when(given, F.col("g.p")).alias("origin_path"))
