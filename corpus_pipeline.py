"""Corpus pipeline: documents to a training order in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and calls one operator of
``railyard.llm`` on all rows that its predecessor kept.  ``run`` writes each
stage's result to the shared checkpoint folder as Parquet and rereads it.
Rows that share an id but differ in text are told apart by a hash of both;
empty tables pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from railyard.llm.common import rows_with, rows_without, sized
from railyard.llm.decontaminate import decontaminate
from railyard.llm.langid import fit, identify
from railyard.llm.mixing import curriculum_mix, in_training_order
from railyard.llm.registry import CURVES
from railyard.llm.simhash import simhash_near_dedup
from railyard.llm.suffix_dedup import document_key, suffix_array_dedup
from railyard.session import scratch_path


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_key", document_key())


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language; those that get ``und`` (no letters) go."""
    found = identify(docs, fit(docs), carry=docs.columns)
    return found.filter(F.col("lang_pred") != "und").select(*[F.col("carried")[c].alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group; of its repeated rows one."""
    who = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_key").alias("key"))
    keyed = _keyed(docs)
    found = simhash_near_dedup(keyed.withColumn("_who", who), id_col="_who", shingle=4, max_bits=4)
    # the few rows that go, or that are repeated, are joined to the texts; the many that stay need not move
    of_key = found.groupBy(F.col("doc_id.key").alias("_key")).agg(
        F.bool_or(F.col("doc_id") == F.col("component_id")).alias("first"), F.count("*").alias("n")).filter("NOT first OR n > 1")
    of_key = sized(of_key, "near-duplicates")
    once = rows_without(keyed, of_key, "_key")
    again = of_key.filter("first").select("_key")
    again = rows_with(keyed, again, "_key").join(again, "_key", "left_semi").dropDuplicates(["_key"])
    return once.unionByName(again).select(*docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes that start earlier; a document of which nothing is left goes.
    Characters that a cut has split are left out."""
    others = [c for c in docs.columns if c != "text"]
    found = suffix_array_dedup(docs, length=100, carry=others, whole_characters=True)
    found = found.filter((F.col("n_removed") < F.col("n_bytes")) | (F.col("n_bytes") == 0))
    new = {"text": F.col("kept")}
    if "n_chars" in others:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("carried.n_chars"))
    return found.select(*[new.get(c, F.col("carried")[c]).alias(c) for c in docs.columns])


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words with the benchmark."""
    keyed = _keyed(docs)
    found = decontaminate(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="_key")
    hit = sized(found.filter("contaminated").select(F.col("doc_id").alias("_key")).distinct(), "contaminated")
    return rows_without(keyed, hit, "_key").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training order: one row per reading of a document, by position."""
    return in_training_order(curriculum_mix(docs, CURVES))


STAGES = [("language_id", language_id), ("simhash_near_dedup", near_duplicates), ("suffix_array_dedup", repeats),
          ("decontaminate", benchmark_free), ("mix_sources", mixture)]

# forward-backward, components over bit distances and the suffix order are not expressible in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_path(spark, f"pipeline-{uuid.uuid4().hex}")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
