"""Batch reports over a behaviour log of user_id, item_id, category, behavior, ts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import squeeze_space, strip_space
from tallyloom.functions.time import DAY_S, day_number, day_text


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, rounded half up to two digits in whole numbers, so every engine gets the same; null where whole is 0."""
    part, whole = part.cast("bigint"), F.nullif(whole.cast("bigint"), F.lit(0).cast("bigint"))
    return F.call_function("div", part * 20_000 + whole, whole * 2).cast("double") / 100


def behavior_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("behavior").agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), "behavior")


def formatted_counts(log: DataFrame) -> DataFrame:
    """Counts per behavior with thousands separators."""
    return behavior_counts(log).select("behavior", F.format_number("cnt", 0).alias("cnt_text"))


def category_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("category").agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), "category")


def top_users(log: DataFrame, n: int = 10) -> DataFrame:
    """The n users with the most views; ties by user."""
    return log.filter("behavior = 'pv'").groupBy("user_id").agg(F.count(F.lit(1)).alias("pv")).orderBy(F.desc("pv"), "user_id").limit(n)


def funnel(spark: SparkSession, log: DataFrame, view: str = "user_behavior") -> DataFrame:
    """Views, carts, purchases and conversion per category, as SQL over a temporary view."""
    log.createOrReplaceTempView(view)
    return spark.sql(f"""
        SELECT category, pv_cnt, cart_cnt, buy_cnt,
               CAST((buy_cnt * 20000 + pv_cnt) DIV (2 * nullif(pv_cnt, 0)) AS DOUBLE) / 100 AS conv_rate_pct
        FROM (SELECT category, count_if(behavior = 'pv') AS pv_cnt, count_if(behavior = 'cart') AS cart_cnt, count_if(behavior = 'buy') AS buy_cnt
              FROM {view} GROUP BY category)
        ORDER BY buy_cnt DESC, category""")


def hour_trend(log: DataFrame) -> DataFrame:
    """Views and distinct viewers per hour of the day (UTC)."""
    hour = (F.pmod(F.col("ts"), F.lit(DAY_S)) / 3600).cast("int").alias("hour")
    return log.filter("behavior = 'pv'").groupBy(hour).agg(F.count(F.lit(1)).alias("pv"), F.countDistinct("user_id").alias("uv")).orderBy("hour")


def top_items(log: DataFrame, n: int = 3) -> DataFrame:
    """Items with rank up to n by purchases within their category; ties share a rank, so there may be more than n. The rank limit is taken before the shuffle."""
    counts = log.filter("behavior = 'buy'").groupBy("category", "item_id").agg(F.count(F.lit(1)).alias("buy_cnt"))
    return counts.withColumn("rk", F.rank().over(Window.partitionBy("category").orderBy(F.desc("buy_cnt")))).filter(F.col("rk") <= n).orderBy("category", "rk", "item_id")


def _count(b: str) -> Column:
    return F.count_if(F.col("behavior") == b)


def category_metrics(log: DataFrame) -> DataFrame:
    """Active days, interactions, users, items, views, carts, purchases, conversion, share of all interactions and rank per category."""
    per = log.groupBy("category").agg(
        F.countDistinct(day_number(F.col("ts"))).alias("active_days"),
        F.count(F.lit(1)).alias("total_interactions"),
        F.countDistinct("user_id").alias("total_users"),
        F.countDistinct("item_id").alias("total_items"),
        _count("pv").alias("total_views"),
        _count("cart").alias("total_carts"),
        _count("buy").alias("total_buys"),
    )
    # One row per category: the window over all of them is small whatever the log's size.
    every = Window.partitionBy(F.lit(0))
    return per.select(
        "*",
        percent(F.col("total_buys"), F.col("total_views")).alias("avg_conversion_rate"),
        percent(F.col("total_interactions"), F.sum("total_interactions").over(every)).alias("market_share"),
        F.rank().over(every.orderBy(F.desc("total_interactions"))).alias("category_rank"),
    ).orderBy("category_rank", "category")


def user_metrics(log: DataFrame) -> DataFrame:
    """Days, actions, conversion, score, level and last day per user. Score: view 1, favourite 3, cart 5, purchase 10. Levels: 1000 and more high, 200 and more medium, else low."""
    per = log.groupBy("user_id").agg(
        F.countDistinct(day_number(F.col("ts"))).alias("active_days"),
        F.count(F.lit(1)).alias("total_behaviors"),
        _count("pv").alias("total_views"),
        _count("cart").alias("total_carts"),
        _count("buy").alias("total_buys"),
        _count("fav").alias("total_favs"),
        F.max(day_number(F.col("ts"))).alias("_last"),
    )
    score = F.col("total_views") + 3 * F.col("total_favs") + 5 * F.col("total_carts") + 10 * F.col("total_buys")
    return per.select(
        "user_id",
        F.when(score >= 1000, "high").when(score >= 200, "medium").otherwise("low").alias("user_level"),
        "active_days",
        "total_behaviors",
        "total_views",
        "total_carts",
        "total_buys",
        percent(F.col("total_buys"), F.col("total_views")).alias("avg_conversion_rate"),
        score.alias("user_value_score"),
        day_text(F.col("_last")).alias("last_active_date"),
    )


def top_user_metrics(log: DataFrame, n: int = 10) -> DataFrame:
    return user_metrics(log).orderBy(F.desc("user_value_score"), "user_id").limit(n)


def clock(ts: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` (UTC) of epoch seconds, whatever the session's time zone."""
    part = lambda x: F.lpad(x.cast("string"), 2, "0")
    s = F.pmod(ts, F.lit(DAY_S)).cast("int")
    div = lambda a, b: F.call_function("div", a, F.lit(b)).cast("int")
    return F.concat(day_text(day_number(ts)), F.lit(" "), part(div(s, 3600)), F.lit(":"), part(F.pmod(div(s, 60), F.lit(60))), F.lit(":"), part(F.pmod(s, F.lit(60))))


def realtime_metrics(log: DataFrame, width_s: int = 300) -> DataFrame:
    """Events, users, counts per behavior and conversion per tumbling window and category."""
    start = F.col("ts") - F.pmod(F.col("ts"), F.lit(width_s).cast("bigint"))
    per = log.groupBy(start.alias("_start"), "category").agg(
        F.count(F.lit(1)).alias("total_events"), F.countDistinct("user_id").alias("unique_users"), _count("pv").alias("view_count"), _count("cart").alias("cart_count"), _count("buy").alias("buy_count"), _count("fav").alias("fav_count")
    )
    return per.select(
        clock(F.col("_start")).alias("window_start"),
        clock(F.col("_start") + width_s).alias("window_end"),
        "category", "total_events", "unique_users", "view_count", "cart_count", "buy_count", "fav_count",
        percent(F.col("buy_count"), F.col("view_count")).alias("conversion_rate"),
    )


#: Rules of the metric alerts: type, metric, 1 for above and -1 for below, threshold, level.
ALERT_RULES = (("conversion", "avg_conversion_rate", -1, 7.5, "warning"), ("traffic", "total_interactions", 1, 2000.0, "info"), ("share", "market_share", 1, 10.0, "critical"))


def metric_alerts(log: DataFrame, rules: tuple = ALERT_RULES) -> DataFrame:
    """Category metrics beyond the threshold of a rule: alert_type, alert_level, category, metric_name, metric_value, threshold, description."""
    names = sorted({r[1] for r in rules})
    metrics = category_metrics(log).select("category", F.explode(F.array(*[F.struct(F.lit(n).alias("metric_name"), F.col(n).cast("double").alias("metric_value")) for n in names])).alias("m")).select("category", "m.*")
    table = F.explode(F.array(*[F.struct(F.lit(t).alias("alert_type"), F.lit(m).alias("rule_metric"), F.lit(s).alias("side"), F.lit(float(v)).alias("threshold"), F.lit(lv).alias("alert_level")) for t, m, s, v, lv in rules]))
    joined = metrics.withColumn("r", table).select("*", "r.*").filter("metric_name = rule_metric and side * (metric_value - threshold) > 0")
    word = F.when(F.col("side") > 0, "above").otherwise("below")
    return joined.select("alert_type", "alert_level", "category", "metric_name", "metric_value", "threshold", F.concat_ws(" ", "category", "metric_name", word, F.lit("threshold")).alias("description"))


def behavior_funnel(log: DataFrame) -> DataFrame:
    """The steps pv, fav, cart, buy in this order with count and rate relative to pv; a step that doesn't occur counts 0."""
    one = log.agg(*[_count(b).alias(b) for b in ("pv", "fav", "cart", "buy")])
    steps = F.array(*[F.struct(F.lit(i).alias("step_no"), F.lit(b).alias("step_name"), F.col(b).alias("cnt")) for i, b in enumerate(("pv", "fav", "cart", "buy"), 1)])
    return one.select("pv", F.explode(steps).alias("s")).select("s.step_no", "s.step_name", "s.cnt", F.coalesce(percent(F.col("s.cnt"), F.col("pv")), F.lit(0.0)).alias("conversion_rate"))


def site_summary(log: DataFrame) -> DataFrame:
    """One row of sums over categories. total_users adds users of several categories up repeatedly, as dashboards do; distinct_users doesn't."""
    sums = category_metrics(log).agg(
        F.sum("total_interactions").alias("total_interactions"), F.sum("total_users").alias("total_users"), F.sum("total_buys").alias("total_buys"), F.sum("total_views").alias("total_views"), F.count(F.lit(1)).alias("categories")
    )
    users = log.agg(F.countDistinct("user_id").alias("distinct_users"))
    # Both sides are one row by construction.
    return sums.join(F.broadcast(users), F.lit(True)).withColumn("avg_conversion_rate", percent(F.col("total_buys"), F.col("total_views")))


def bar_widths(log: DataFrame) -> DataFrame:
    """Width in percent of the longest bar, 16 at least, of each category's interactions."""
    c = category_counts(log)
    top = F.max("cnt").over(Window.partitionBy(F.lit(0)))
    return c.select("category", "cnt", F.greatest(F.lit(16), F.call_function("div", F.col("cnt") * 200 + top, top * 2).cast("int")).alias("width"))


#: Other spellings of alert levels.
_LEVELS = {"warn": "warning", "crit": "critical", "information": "info"}


def clean_alerts(alerts: DataFrame) -> DataFrame:
    """Distinct alerts in normal form: level and category in lower case without extra white space, warn as warning, NaN as null, and times of any of the notations
    ``Y-m-d H:M[:S]``, ``Y/m/d H:M:S`` and ``Y-m-dTH:M:SZ`` as ``Y-m-d H:M:S``; a time in none of them becomes null. Nulls stay null."""
    level = F.lower(strip_space(F.col("alert_level")))
    level = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in _LEVELS.items() for x in kv]), level), level)
    number = lambda c: F.when(~F.isnan(c), F.col(c))
    t = strip_space(F.regexp_replace(F.translate("alert_time", "/T", "- "), "Z", ""))
    t = F.when(F.length(t) == 16, F.concat(t, F.lit(":00"))).otherwise(t)
    return alerts.select(
        F.lower(strip_space(F.col("alert_type"))).alias("alert_type"),
        level.alias("alert_level"),
        F.lower(squeeze_space(F.col("category"))).alias("category"),
        F.lower(strip_space(F.col("metric_name"))).alias("metric_name"),
        number("metric_value").alias("metric_value"),
        number("threshold").alias("threshold"),
        F.when(t.rlike(r"\A\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\z"), t).alias("alert_time"),
        "description",
    ).distinct()


def latest_alerts(alerts: DataFrame, n: int = 8) -> DataFrame:
    """The n latest alerts; further columns break ties."""
    return clean_alerts(alerts).orderBy(*[F.desc_nulls_last(c) for c in ("alert_time", "alert_type", "category", "metric_name", "metric_value", "alert_level", "threshold", "description")]).limit(n)
