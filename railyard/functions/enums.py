"""Enum values ordered by declaration, not by the alphabet."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from railyard.schemas import ENUMS


def _domain(enum: str) -> Column:
    return F.array(*[F.lit(v) for v in ENUMS[enum]])


def enum_ordinal(col: Column | str, enum: str) -> Column:
    """1-based position of the value in its enum domain; NULL for NULL or a non-member."""
    return F.nullif(F.array_position(_domain(enum), F.col(col) if isinstance(col, str) else col), F.lit(0)).cast("int")


def enum_max(col: Column | str, enum: str) -> Column:
    """Aggregate: the greatest enum value by declaration order (``MAX`` over a Postgres enum).

    The maximum is taken over the integer ordinal and mapped back to the
    label, so the aggregation buffer is one int: Spark keeps it in a hash
    aggregate (a string-valued ``max_by`` buffer would force a sort-based one).
    """
    c = F.col(col) if isinstance(col, str) else col
    m = F.max(enum_ordinal(c, enum))
    # explicit NULL guard: element_at over a literal array does not return NULL
    # for a NULL index after aggregation in this Spark version
    return F.when(m.isNotNull(), F.element_at(_domain(enum), m))


def enum_at(index: Column, enum: str) -> Column:
    """Domain value at a 0-based index column (index taken modulo the domain size)."""
    n = len(ENUMS[enum])
    return F.when(index.isNotNull(), F.element_at(_domain(enum), (F.pmod(index, F.lit(n)) + 1).cast("int")))


def checked_enum(col: Column | str, enum: str) -> Column:
    """Text → enum value: members and NULL pass through, any other text fails
    the query (as converting an unknown value to an enum does)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isNull() | c.isin(ENUMS[enum]), c).otherwise(
        F.raise_error(F.concat(F.lit(f"unknown {enum} value: "), c)))
