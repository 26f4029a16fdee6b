"""Parsing and validation of raw CSV lines, with time features and a count of what is rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.schema import BEHAVIORS

HEADER = "userId,itemId,category,behavior,timestamp"
#: Reasons of rejection, in the order they are tested.
REASONS = ("null_line", "header", "field_count", "empty_field", "behavior", "timestamp")
_FIELDS = ("user_id", "item_id", "category", "behavior")


def _trim(c: Column) -> Column:
    """Without characters up to U+0020 at both ends."""
    return F.regexp_replace(c, r"\A[\x00-\x20]+|[\x00-\x20]+\z", "")


def parse_log_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """The columns of lines, and user_id, item_id, category, behavior, ts and reject (null for a good line).

    A line is rejected as null_line; header, wherever it stands and also behind a byte order mark; field_count unless it has five fields; empty_field if one is
    empty after trimming; behavior if it isn't pv, buy, cart or fav; timestamp if it isn't a whole number above 0.
    """
    fields = F.transform(F.split(F.col(line), ",", -1), _trim)
    f = F.col("_f")
    ts = F.try_element_at(f, F.lit(5)).try_cast("bigint")
    reject = (
        F.when(F.col(line).isNull(), "null_line")
        .when(F.regexp_replace(_trim(F.col(line)), "﻿", "") == HEADER, "header")
        .when(F.size(f) != 5, "field_count")
        .when(F.exists(f, lambda x: F.length(x) == 0), "empty_field")
        .when(~F.try_element_at(f, F.lit(4)).isin(*BEHAVIORS), "behavior")
        .when(F.coalesce(ts, F.lit(0)) <= 0, "timestamp")
    )
    parsed = lines.withColumn("_f", fields).withColumn("reject", reject)
    return parsed.select(*[F.col(c) for c in lines.columns], *[F.try_element_at(f, F.lit(i + 1)).alias(n) for i, n in enumerate(_FIELDS)], ts.alias("ts"), "reject")


def clean_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """user_id, item_id, category, behavior, ts of the good lines."""
    return parse_log_lines(lines, line).filter("reject is null").select(*_FIELDS, "ts")


def quality(lines: DataFrame, line: str = "line") -> DataFrame:
    """One row: lines in all, lines kept, and one count per reason, in a single pass."""
    parsed = parse_log_lines(lines, line)
    return parsed.agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("reject").isNull()).alias("kept"), *[F.count_if(F.coalesce(F.col("reject") == r, F.lit(False))).alias(r) for r in REASONS]
    )


#: 2000-01-01 and the length of the calendar's cycle of 400 years, in seconds; weekdays repeat with it.
_Y2000, _CYCLE, _Y10000 = 946_684_800, 146_097 * 86_400, 253_402_300_800


def local_time(ts: Column, timezone: str) -> Column:
    """TIMESTAMP_NTZ of epoch seconds in a time zone, whatever the session's. Times outside the years 1 to 9999 are moved by whole cycles of 400 years into 2000 to
    2399: hour and weekday stay right."""
    far = F.lit(_Y2000).cast("bigint") + F.pmod(ts - F.lit(_Y2000), F.lit(_CYCLE).cast("bigint"))
    near = F.when((ts < _Y10000) & (ts > -62_135_596_800), ts).otherwise(far)
    return F.convert_timezone(F.lit("UTC"), F.lit(timezone), F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), near.cast("decimal(18,6)")))


def time_features(df: DataFrame, timezone: str = "Asia/Shanghai", ts: str = "ts") -> DataFrame:
    """df with hour (0-23), day_of_week (1 = Monday) and is_weekend (0 or 1) of ts in the time zone; null for a null ts."""
    t = local_time(F.col(ts), timezone)
    day = F.weekday(t) + 1
    return df.withColumn("hour", F.hour(t)).withColumn("day_of_week", day).withColumn("is_weekend", F.when(day >= 6, 1).when(day < 6, 0))


def filter_categories(df: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """Rows of the given categories; a short literal list needs no join."""
    return df.filter(F.col("category").isin(*categories))


def node_errors(nodes: DataFrame) -> DataFrame:
    """Rows of graph nodes (user_id, pv_count) that break their rules: a user, and a count that is not negative."""
    return nodes.filter(~F.coalesce((F.length("user_id") > 0) & (F.col("pv_count") >= 0), F.lit(False)))


def edge_errors(edges: DataFrame) -> DataFrame:
    """Rows of graph edges (src, dst, weight) that break their rules: both ends, and a weight that is not negative."""
    return edges.filter(~F.coalesce((F.length("src") > 0) & (F.length("dst") > 0) & (F.col("weight") >= 0) & ~F.isnan(F.col("weight").cast("double")), F.lit(False)))


def report_errors(report: DataFrame) -> DataFrame:
    """Rows of a sales report (category, total_pv, total_buy, report_date) that break its rules: counts not negative, category and date not empty."""
    ok = (F.col("total_pv") >= 0) & (F.col("total_buy") >= 0) & (F.length("report_date") > 0) & (F.length("category") > 0)
    return report.filter(~F.coalesce(ok, F.lit(False)))
