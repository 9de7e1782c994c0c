"""Report date windows.

All "today" values are an explicit ``as_of`` argument, so a job re-run (or a
retried task) sees the same window.  Dates are validated here, before any plan
is built.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Window:
    start: dt.date
    end: dt.date

    def __post_init__(self):
        if self.start > self.end:
            raise ValueError(f"empty window: {self.start} is later than {self.end}")


def parse_iso_date(value: str | dt.date | None, name: str = "date") -> dt.date | None:
    if value is None or isinstance(value, dt.date):
        return value
    parts = re.fullmatch(r"(\d{4})-(\d{2})-(\d{2})", value)
    try:
        return dt.date(*map(int, parts.groups()))
    except (AttributeError, ValueError):
        raise ValueError(f"{name} {value!r} is not a calendar day written as year-month-day") from None


def resolve_window(start=None, end=None, as_of: dt.date | str | None = None,
                   mode: str = "independent") -> Window:
    """Resolve optional start/end dates to a concrete inclusive window.

    mode="independent"     (command line) a missing start becomes the 1st of the
                           as_of month, a missing end becomes as_of, each on its own.
    mode="both_or_current" (API) the given dates are used only when both are
                           present; otherwise the window is month-to-date.
    """
    as_of = parse_iso_date(as_of, "as_of") or dt.date.today()
    s, e = parse_iso_date(start, "start_date"), parse_iso_date(end, "end_date")
    first = as_of.replace(day=1)
    if mode == "independent":
        return Window(s or first, e or as_of)
    if mode == "both_or_current":
        return Window(s, e) if (s is not None and e is not None) else Window(first, as_of)
    raise ValueError(f"unknown window mode {mode!r}")


def previous_month(as_of: dt.date | str) -> Window:
    """The last full calendar month before ``as_of``."""
    as_of = parse_iso_date(as_of, "as_of")
    end = as_of.replace(day=1) - dt.timedelta(days=1)
    return Window(end.replace(day=1), end)


def in_window(ts: Column, window: Window) -> Column:
    """``ts::date BETWEEN start AND end`` (inclusive, in the session time zone).

    Catalyst rewrites the date cast into a half-open timestamp range, which is
    pushed to the Parquet scan (and prunes ``issue_month`` partitions).
    """
    return F.to_date(ts).between(F.lit(window.start), F.lit(window.end))

