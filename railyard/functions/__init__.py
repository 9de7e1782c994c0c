"""Column-expression helpers.  All are built-in Spark expressions (no UDFs)."""

from railyard.functions.enums import enum_max, enum_ordinal, enum_at
from railyard.functions.refs import gen_ref, padded, padded_ref
from railyard.functions.timefmt import duration_seconds, duration_text, iso_utc

__all__ = ["enum_max", "enum_ordinal", "enum_at", "gen_ref", "padded", "padded_ref",
           "duration_seconds", "duration_text", "iso_utc"]
