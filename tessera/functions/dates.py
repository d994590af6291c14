"""Parts and differences of dates that engines count in different ways, each by a stated rule.  Nulls give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def weekday(at: str) -> Column:
    """0 for Sunday to 6 for Saturday."""
    return (F.dayofweek(at) - 1).cast("long")


def second_of(at: str) -> Column:
    """The second with its fraction, 0 to under 60."""
    return F.pmod(F.unix_micros(F.col(at).cast("timestamp")), F.lit(60_000_000)) / 1e6


def month_number(at: str) -> Column:
    return (F.year(at) * 12 + F.month(at)).cast("long")


def months_crossed(a: str, b: str) -> Column:
    """Month boundaries from a to b: 1 from January 31 to February 1."""
    return month_number(b) - month_number(a)


def whole_months(a: str, b: str) -> Column:
    """Whole months from a to b, for a before b: a month ends on the same day of month and time; a shorter month on its last day
    ends none by itself."""
    return F.expr(f"CAST(timestampdiff(MONTH, `{a}`, `{b}`) AS BIGINT)")


def quarters_crossed(a: str, b: str) -> Column:
    number = lambda x: (F.year(x) * 4 + F.quarter(x)).cast("long")
    return number(b) - number(a)


def weeks_crossed(a: str, b: str) -> Column:
    """Mondays from a to b: the week begins there."""
    monday = lambda x: F.datediff(F.trunc(x, "week"), F.lit("1970-01-05").cast("date"))
    return ((monday(b) - monday(a)) / 7).cast("long")


def whole_years(a: str, b: str) -> Column:
    """Birthdays from a to b, for a before b: the month and day of a have come again."""
    day = lambda x: F.month(x) * 100 + F.dayofmonth(x)
    return (F.year(b) - F.year(a) - F.when(day(b) < day(a), 1).otherwise(0)).cast("long")
