import datetime as dt

import pytest

from railyard.plans.window import Window, previous_month, resolve_window


def test_independent_defaults():
    w = resolve_window(None, None, "2024-03-17")
    assert (w.start, w.end) == (dt.date(2024, 3, 1), dt.date(2024, 3, 17))
    w = resolve_window("2024-02-10", None, "2024-03-17")
    assert (w.start, w.end) == (dt.date(2024, 2, 10), dt.date(2024, 3, 17))
    w = resolve_window(None, "2024-03-05", "2024-03-17")
    assert (w.start, w.end) == (dt.date(2024, 3, 1), dt.date(2024, 3, 5))


def test_both_or_current():
    w = resolve_window("2024-01-01", None, "2024-03-17", mode="both_or_current")
    assert (w.start, w.end) == (dt.date(2024, 3, 1), dt.date(2024, 3, 17))
    w = resolve_window("2024-01-01", "2024-01-31", "2024-03-17", mode="both_or_current")
    assert (w.start, w.end) == (dt.date(2024, 1, 1), dt.date(2024, 1, 31))


def test_previous_month_year_boundary_and_leap():
    assert previous_month("2024-01-15") == Window(dt.date(2023, 12, 1), dt.date(2023, 12, 31))
    assert previous_month("2024-03-01") == Window(dt.date(2024, 2, 1), dt.date(2024, 2, 29))
    assert previous_month("2023-03-31") == Window(dt.date(2023, 2, 1), dt.date(2023, 2, 28))


def test_validation():
    with pytest.raises(ValueError, match="later"):
        resolve_window("2024-02-02", "2024-02-01", "2024-03-01")
    with pytest.raises(ValueError, match="calendar day"):
        resolve_window("2024-13-01", None, "2024-03-01")
    with pytest.raises(ValueError, match="calendar day"):
        resolve_window("01/02/2024", None, "2024-03-01")
