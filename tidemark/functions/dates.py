"""Business-day arithmetic (Monday to Friday, no holidays) in closed form, and quarter helpers.

Every weekday has an ordinal, so differences, offsets and ranges need no calendar table, no
sequence and no UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONDAY = "1970-01-05"


def _days(d: Column) -> Column:
    return F.date_diff(d, F.lit(_MONDAY).cast("date"))


def is_business_day(d: Column) -> Column:
    return F.weekday(d) < 5


def business_ordinal(d: Column) -> Column:
    """Number of weekdays strictly before ``d`` (counted from a fixed Monday)."""
    days = _days(d)
    week = F.floor(days / 7).cast("int")
    return week * 5 + F.least(days - week * 7, F.lit(5))


def business_date(ordinal: Column) -> Column:
    """Inverse of :func:`business_ordinal` on weekdays."""
    week = F.floor(ordinal / 5).cast("int")
    return F.date_add(F.lit(_MONDAY).cast("date"), (week * 7 + (ordinal - week * 5)).cast("int"))


def business_lag(last: Column, as_of: Column) -> Column:
    """Weekdays in ``[last, as_of)``."""
    return business_ordinal(as_of) - business_ordinal(last)


def business_shift(d: Column, n: int) -> Column:
    """Move by ``n`` weekdays; a weekend date first steps onto the neighbouring weekday (F8)."""
    base = business_ordinal(d) + n
    return business_date(F.when(is_business_day(d) | F.lit(n <= 0), base).otherwise(base - 1))


def quarter_end(d: Column) -> Column:
    """Last day of the calendar quarter of ``d``."""
    return F.date_sub(F.add_months(F.trunc(d, "quarter"), 3), 1)


def previous_quarter_end(d: Column) -> Column:
    """Last calendar quarter end strictly before ``d``."""
    return F.date_sub(F.trunc(d, "quarter"), 1)
