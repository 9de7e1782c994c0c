"""Semi-structured inputs: JSON payload columns and pod-list documents.

Parsing is ``from_json`` with a declared schema (malformed input → NULL,
never a failed task), ``explode`` for arrays, and ``parse_json``/
``variant_get`` when the shape is open-ended.  All of it runs in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The parts of a pod-list document that are read: items[].metadata.name,
# items[].metadata.labels, items[].status.phase.
POD_LIST_SCHEMA = T.StructType([
    T.StructField("items", T.ArrayType(T.StructType([
        T.StructField("metadata", T.StructType([
            T.StructField("name", T.StringType()),
            T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
        ])),
        T.StructField("status", T.StructType([T.StructField("phase", T.StringType())])),
    ]))),
])


def pod_list_items(docs: DataFrame, column: str = "json", keep: list[str] | None = None) -> DataFrame:
    """One row per pod of each pod-list document: name, phase, labels and its
    position in the list (``ord``, for "first item" rules)."""
    parsed = docs.select(*(keep or []), F.from_json(F.col(column), POD_LIST_SCHEMA).alias("__d"))
    return parsed.select(*(keep or []), F.posexplode("__d.items").alias("ord", "__i")).select(
        *(keep or []), "ord", F.col("__i.metadata.name").alias("name"),
        F.col("__i.status.phase").alias("phase"), F.col("__i.metadata.labels").alias("labels"))


def json_field(payload: Column, path: str, dtype: str = "string") -> Column:
    """One value of a JSON text column by path (``$.a.b``); NULL if absent or malformed."""
    return F.get_json_object(payload, path).try_cast(dtype)


def payload_variant(payload: Column) -> Column:
    """JSON text → VARIANT (``try_parse_json``: malformed → NULL) for open-ended payloads."""
    return F.try_parse_json(payload)


def label(labels: Column, key: str) -> Column:
    """Map value by key; NULL when the map or the key is missing."""
    return F.try_element_at(labels, F.lit(key))
