"""Calendar columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_of(ts: Column) -> Column:
    """First day of the month, as a date."""
    return F.trunc(ts, "month")


def month_index(month: Column) -> Column:
    """Months since year 0: neighbours in time differ by one, whatever rows exist."""
    return F.year(month) * 12 + F.month(month)
