"""JSON payloads whose shape nobody declared: profile it, then read it into typed columns.

Text becomes VARIANT (malformed text is kept and counted, it never fails a
task); the shape is an aggregate over all rows, partial before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

VARIANT = "__variant"


def parsed(df: DataFrame, column: str) -> DataFrame:
    """``df`` with the payload as VARIANT and ``malformed`` (text that is no JSON; NULL text is not malformed)."""
    v = F.try_parse_json(column)
    return df.withColumn(VARIANT, v).withColumn("malformed", F.col(column).isNotNull() & F.col(VARIANT).isNull())


def _is_object() -> Column:
    return F.schema_of_variant(VARIANT).startswith("OBJECT<")


def kind(schema: Column) -> Column:
    """JSON kind of a variant's schema text."""
    return (F.when(schema.startswith("OBJECT"), "object").when(schema.startswith("ARRAY"), "array")
             .when(schema == "STRING", "string").when(schema == "BOOLEAN", "boolean").when(schema == "VOID", "null").otherwise("number"))


def key_profile(df: DataFrame, column: str) -> DataFrame:
    """``key, kind, n``: how often each top-level key occurs with each kind of value.

    Rows whose payload is not an object are counted under no key by their kind,
    malformed ones as ``malformed``.
    """
    p = parsed(df.select(column), column)
    inner = p.filter(_is_object()).select(VARIANT).lateralJoin(df.sparkSession.tvf.variant_explode(F.col(VARIANT).outer()))
    keys = inner.groupBy("key", kind(F.schema_of_variant("value")).alias("kind")).agg(F.count("*").alias("n"))
    other = p.filter(F.col("malformed") | (F.col(VARIANT).isNotNull() & ~_is_object()))
    other = other.groupBy(F.when(F.col("malformed"), "malformed").otherwise(kind(F.schema_of_variant(VARIANT))).alias("kind")).agg(F.count("*").alias("n"))
    return keys.unionByName(other.select(F.lit(None).cast("string").alias("key"), "kind", "n"))


def shape(df: DataFrame, column: str) -> T.StructType:
    """Type of all object payloads together: one text of the driver, whatever the number of rows.

    A key with values of different types is VARIANT.
    """
    p = parsed(df.select(column), column).filter(_is_object())
    text = p.agg(F.schema_of_variant_agg(VARIANT)).first()[0]
    if not text or not text.startswith("OBJECT<"):
        return T.StructType([])
    return T.DataType.fromDDL(text.replace("OBJECT<", "STRUCT<"))


def typed(df: DataFrame, column: str, fields: T.StructType | None = None) -> DataFrame:
    """``df`` with the struct ``payload`` of the fields of ``shape`` (or the given ones) and ``malformed``.

    A value that does not fit its field is NULL.
    """
    fields = fields if fields is not None else shape(df, column)
    p = parsed(df, column)

    def value(f):
        # names go as path text; a quote in one is doubled by the path's own rule of brackets
        return F.try_variant_get(F.when(_is_object(), F.col(VARIANT)), f"$['{f.name}']", f.dataType.simpleString()).alias(f.name)
    payload = F.struct(*[value(f) for f in fields]) if fields else F.lit(None).cast("struct<>")
    return p.withColumn("payload", payload).drop(VARIANT)
