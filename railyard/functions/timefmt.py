"""Durations and timestamp text for job status records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration_seconds(start: Column, end: Column, as_of: Column) -> Column:
    """Whole seconds from start to end (or to ``as_of`` while running); 0 without a start.

    Floor of the exact difference, as a duration's seconds part is.
    """
    stop = F.coalesce(end, as_of)
    micros = F.unix_micros(stop) - F.unix_micros(start)
    return (F.when(start.isNull(), F.lit(0).cast("long"))
            .otherwise(F.floor(micros / F.lit(1000000)).cast("long")))


def duration_text(seconds: Column) -> Column:
    """``0s`` for zero/NULL, ``Ns`` under a minute, else ``Mm Ss``."""
    s = seconds.cast("long")
    return (F.when(s.isNull() | (s == 0), F.lit("0s"))
            .when(s < 60, F.concat(s.cast("string"), F.lit("s")))
            .otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit("m "),
                                F.pmod(s, F.lit(60)).cast("string"), F.lit("s"))))


def iso_utc(ts: Column) -> Column:
    """``yyyy-MM-dd'T'HH:mm:ss'Z'`` of an instant, in UTC whatever the session zone."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
