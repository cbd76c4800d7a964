"""Calendar expressions with one meaning on every engine: DATE in, DATE or BIGINT out."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_start(date: Column) -> Column:
    return F.trunc(date, "MM")


def quarter_start(date: Column) -> Column:
    return F.trunc(date, "QUARTER")


def year_start(date: Column) -> Column:
    return F.trunc(date, "YEAR")


def year(date: Column) -> Column:
    return F.year(date).cast("long")


def quarter(date: Column) -> Column:
    return F.quarter(date).cast("long")


def month(date: Column) -> Column:
    return F.month(date).cast("long")


def day_of_week(date: Column) -> Column:
    """Sunday = 0 … Saturday = 6."""
    return (F.dayofweek(date) - 1).cast("long")


def months_between_starts(earlier: Column, later: Column) -> Column:
    """Month boundaries crossed, negative when ``later`` lies in an earlier month."""
    return (year(later) * 12 + month(later)) - (year(earlier) * 12 + month(earlier))


def window_start(as_of: dt.date, days: int) -> dt.date:
    """First day of a window reaching ``days`` back from ``as_of``."""
    return as_of - dt.timedelta(days=days)
