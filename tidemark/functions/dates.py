"""Comparisons by day, written as comparisons of the timestamp itself so that they reach the scan."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_start(as_of: dt.date, days_back: int = 0) -> Column:
    """Midnight, in the session's time zone, of the day so many days before."""
    return F.lit((as_of - dt.timedelta(days=days_back)).isoformat()).cast("timestamp")


def from_day(column: str, as_of: dt.date, days_back: int = 0) -> Column:
    """On that day or later."""
    return F.col(column) >= day_start(as_of, days_back)


def before_day(column: str, as_of: dt.date, days_back: int = 0) -> Column:
    return F.col(column) < day_start(as_of, days_back)


def on_day(column: str, as_of: dt.date) -> Column:
    return from_day(column, as_of) & before_day(column, as_of, -1)
