"""The valid rows of a behaviour log in normal form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import squeeze_space, strip_space, unless_clean
from tallyloom.schema import BEHAVIORS

#: From here on a timestamp counts milliseconds.
MILLIS_FROM = 100_000_000_000


def normal_log(log: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """user_id, item_id, category, behavior, ts in normal form, row by row, and the columns to keep as they are.

    White space (every Unicode kind) goes at both ends, inside category each run becomes one space; ids are in upper case, category and behavior in lower
    case; a timestamp of 10^11 or more counts milliseconds and is cut to seconds. Nulls stay null; other columns of the log are left out.
    """
    user, item, category, behavior, ts = (F.col(f"`{c}`") for c in ("userId", "itemId", "category", "behavior", "timestamp"))
    return log.select(
        unless_clean(user, r"\AU[0-9]+\z", F.upper(strip_space(user))).alias("user_id"),
        unless_clean(item, r"\AI[0-9]+\z", F.upper(strip_space(item))).alias("item_id"),
        F.lower(unless_clean(category, r"\A[A-Za-z]+( [A-Za-z]+)*\z", squeeze_space(category))).alias("category"),
        F.when(behavior.isin(*BEHAVIORS), behavior).otherwise(F.lower(strip_space(behavior))).alias("behavior"),
        F.when(ts >= MILLIS_FROM, F.call_function("div", ts, F.lit(1000).cast("bigint"))).otherwise(ts).cast("bigint").alias("ts"),
        *[F.col(f"`{c}`") for c in keep],
    )


def is_valid() -> Column:
    """Whether a row in normal form is valid; null counts as no."""
    return F.coalesce(
        F.col("user_id").rlike(r"\AU[0-9]+\z")
        & F.col("item_id").rlike(r"\AI[0-9]+\z")
        & (F.col("category") != "")
        & F.col("behavior").isin(*BEHAVIORS)
        & (F.col("ts") > 0),
        F.lit(False),
    )


def valid_rows(log: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Valid rows in normal form, repeated ones kept. What can be told from the stored values is asked of them too, so that the scan skips such rows and row groups."""
    stored = F.col("timestamp") > 0
    for c in ("userId", "itemId", "category", "behavior"):
        stored = stored & F.col(f"`{c}`").isNotNull()
    return normal_log(log.filter(stored), keep).filter(is_valid())


def valid_log(log: DataFrame) -> DataFrame:
    """Valid rows in normal form; rows alike in all five fields count once.

    The one shuffle hashes all five fields, so no user, item or category makes a hot partition, and repeats within a task go before it.
    """
    return valid_rows(log).distinct()
