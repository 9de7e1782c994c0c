"""Human-readable reference codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gen_ref(prefix: Column | str, seed: Column, length: int = 8) -> Column:
    """``upper(prefix || '-' || substring(md5(seed), 1, length))``.

    The database function draws ``md5(random())``; here the digest is taken of a
    seed column so that re-running a job (or a retried task) gives the same refs.
    """
    p = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.upper(F.concat(p, F.lit("-"), F.substring(F.md5(seed.cast("string")), 1, length)))


def padded(value: Column, width: int) -> Column:
    """Zero-padded decimal text of an integer (``%0Nd``); longer numbers are kept whole."""
    return F.format_string(f"%0{width}d", value.cast("long"))


def padded_ref(prefix: str, value: Column, width: int = 8) -> Column:
    """``prefix`` followed by the zero-padded number, e.g. ``BKG-00000042``."""
    return F.format_string(f"{prefix}%0{width}d", value.cast("long"))


def short_ref(seed: Column, length: int = 8) -> Column:
    """The first ``length`` characters of the seed's digest in upper case, as ``gen_ref`` without a prefix."""
    return F.upper(F.substring(F.md5(seed.cast("string")), 1, length))
