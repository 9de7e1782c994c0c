"""Join helpers for skewed keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def spread_key(key: Column, salt: Column, dtype) -> tuple[Column, Column]:
    """(is-NULL flag, key-or-salt) for a nullable join key; see ``left_join_spread_nulls``."""
    h = F.hash(salt) if dtype == T.IntegerType() else F.xxhash64(salt)
    return key.isNull(), F.coalesce(key, h.cast(dtype))


def left_join_spread_nulls(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                           salt: Column) -> DataFrame:
    """``left LEFT JOIN right ON left.left_key = right.right_key`` with NULL keys spread out.

    In a shuffle join every left row whose key is NULL hashes to the same
    partition, so a nullable foreign key (a ticket without a booking, seat or
    fare) becomes one hot task.  Here the join is on (is-null flag, key) with
    the NULL key replaced by a hash of ``salt``: the flag is never true on the right
    side, so those rows still match nothing (the left-join result is
    unchanged), but they spread over all shuffle partitions.
    When the planner broadcasts ``right`` the extra columns cost nothing.
    """
    nk, jk = spread_key(F.col(left_key), salt, left.schema[left_key].dataType)
    l2 = left.select("*", nk.alias("__nk"), jk.alias("__jk"))
    r2 = right.select("*", F.lit(False).alias("__rnk"))
    j = l2.join(r2, (l2["__nk"] == r2["__rnk"]) & (l2["__jk"] == r2[right_key]), "left")
    return j.select(*[l2[c] for c in left.columns], *[r2[c] for c in right.columns])
