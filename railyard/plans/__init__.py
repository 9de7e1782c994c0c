"""The ticket report mart and its date windows."""

from railyard.plans.window import Window, resolve_window, previous_month
from railyard.plans.report import (REPORT_COLUMNS, payment_summary, booking_payments,
                                   ticket_report, monthly_report_backfill)

__all__ = ["Window", "resolve_window", "previous_month", "REPORT_COLUMNS",
           "payment_summary", "booking_payments", "ticket_report", "monthly_report_backfill"]
