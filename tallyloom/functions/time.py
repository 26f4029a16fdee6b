"""Time expressions on epoch seconds that don't depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_S = 86_400
#: 9999-12-31, the last day with a four-digit year, counted from 1970-01-01.
LAST_DAY = 2_932_896


def day_number(ts: Column) -> Column:
    """Days since 1970-01-01 (UTC), negative before it; integer arithmetic, exact for every bigint."""
    return F.call_function("div", ts - F.pmod(ts, F.lit(DAY_S).cast("bigint")), F.lit(DAY_S).cast("bigint"))


def day_text(day: Column) -> Column:
    """``YYYY-MM-DD`` of a day number; days after 9999-12-31 are written ``day N`` so that they stay apart."""
    in_range = day <= F.lit(LAST_DAY)
    date = F.date_add(F.lit("1970-01-01").cast("date"), F.when(in_range, day).cast("int"))
    return F.when(in_range, date.cast("string")).otherwise(F.concat(F.lit("day "), day.cast("string")))


def week_start(day: Column) -> Column:
    """Day number of the Monday of the day's week."""
    return day - F.pmod(day + F.lit(3), F.lit(7))
