"""Queries of sources, cleaning, reports, dashboard, streaming, graph, models and tuning, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import clean, graph, propensity, reports, tuning
from tallyloom.plans.sqltext import DAY, VALID
from tallyloom.plans.tables import stored_valid as valid
from tallyloom.plans.tables import table
from tallyloom.schema import DISCOUNTS, FOCUS_CATEGORIES
from tallyloom.session import materialize, new_path
from tallyloom.sinks import tables as sinks
from tallyloom.sources import behavior as sources
from tallyloom.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
FOCUS = tuple(c.lower() for c in FOCUS_CATEGORIES)
#: Rounds of PageRank at most, and when it has converged: far below the digits that are shown.
RANK_ROUNDS, RANK_TOLERANCE = 20, 1e-7


def _register(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "behavior_csv_lines")


# Scans and sinks

_TRIM = r"regexp_replace({0}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"
_PARSED = f"""parsed AS (SELECT file_name, line_no, line, f, {_TRIM.format('f[1]')} AS user_id, {_TRIM.format('f[2]')} AS item_id, {_TRIM.format('f[3]')} AS category, {_TRIM.format('f[4]')} AS behavior,
  TRY_CAST({_TRIM.format('f[5]')} AS BIGINT) AS ts, {_TRIM.format('f[5]')} AS ts_text FROM (SELECT *, string_split(line, ',') AS f FROM behavior_csv_lines)),
 judged AS (SELECT *, CASE WHEN line IS NULL THEN 'null_line' WHEN replace({_TRIM.format('line')}, chr(65279), '') = '{clean.HEADER}' THEN 'header' WHEN len(f) <> 5 THEN 'field_count'
  WHEN user_id = '' OR item_id = '' OR category = '' OR behavior = '' OR ts_text = '' THEN 'empty_field' WHEN behavior NOT IN ('pv', 'fav', 'cart', 'buy') THEN 'behavior'
  WHEN NOT regexp_full_match(ts_text, '[+-]?[0-9]+') OR coalesce(ts, 0) <= 0 THEN 'timestamp' END AS reject FROM parsed)"""


@_register(f"WITH {VALID} SELECT user_id, item_id, category, behavior, ts FROM valid")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid rows written as CSV with header and scanned under the fixed schema."""
    path = new_path(spark, "csv")
    log = valid(spark, sf_dir)
    sinks.write_csv(log.select(*[F.col(a).alias(b) for a, b in zip(log.columns, ("userId", "itemId", "category", "behavior", "timestamp"))]), path)
    return sources.read_csv(spark, path).toDF(*log.columns)


@_register(f"WITH {VALID} SELECT category, count(*) AS total_pv FROM valid WHERE behavior = 'pv' GROUP BY category")
def parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report written to Parquet, overwriting, and read again."""
    path = new_path(spark, "report")
    report = valid(spark, sf_dir).filter("behavior = 'pv'").groupBy("category").agg(F.count(F.lit(1)).alias("total_pv"))
    sinks.write_parquet(report, path)
    return spark.read.parquet(path)


@_register(f"""WITH {_PARSED} SELECT concat_ws(',', user_id, item_id, category, behavior, CAST(hour(l) AS VARCHAR), CAST(isodow(l) AS VARCHAR), CASE WHEN isodow(l) >= 6 THEN '1' ELSE '0' END) AS value
 FROM (SELECT *, make_timestamp((ts + 28800) * 1000000) AS l FROM judged WHERE reject IS NULL)""")
def clean_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean lines with time features as headerless text, read back line by line."""
    path = new_path(spark, "cleaned")
    sinks.write_lines(clean.time_features(clean.clean_lines(_lines(spark, sf_dir))).drop("ts"), path)
    return sources.read_lines(spark, path).withColumnRenamed("line", "value")


@_register()
def gen_behavior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generator's rows."""
    return sources.generate(spark)


# Cleaning


@_register(f"WITH {_PARSED} SELECT user_id, item_id, category, behavior, ts FROM judged WHERE reject IS NULL")
def clean_behavior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_lines(_lines(spark, sf_dir))


@_register(f"""WITH {_PARSED} SELECT count(*) AS lines, count(*) FILTER (reject IS NULL) AS kept, {', '.join(f"count(*) FILTER (reject = '{r}') AS {r}" for r in clean.REASONS)} FROM judged""")
def clean_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.quality(_lines(spark, sf_dir))


@_register(f"""WITH {VALID} SELECT user_id, item_id, category, behavior, ts, CAST(hour(l) AS INTEGER) AS hour, CAST(isodow(l) AS INTEGER) AS day_of_week, CAST(CASE WHEN isodow(l) >= 6 THEN 1 ELSE 0 END AS INTEGER) AS is_weekend
 FROM (SELECT *, make_timestamp((ts + 28800) * 1000000) AS l FROM valid)""")
def time_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.time_features(valid(spark, sf_dir))


@_register(f"WITH {VALID} SELECT category, count(*) AS cnt FROM valid WHERE category IN {FOCUS} GROUP BY category")
def category_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.filter_categories(valid(spark, sf_dir), FOCUS).groupBy("category").agg(F.count(F.lit(1)).alias("cnt"))


# Reports


def _pct(part: str, whole: str) -> str:
    return f"CAST(({part} * 20000 + {whole}) // nullif(2 * {whole}, 0) AS DOUBLE) / 100"


_COUNTS = ", ".join(f"count(*) FILTER (behavior = '{b}') AS {b}" for b in ("pv", "cart", "buy", "fav"))


@_register(f"WITH {VALID}, c AS (SELECT category, {_COUNTS} FROM valid GROUP BY category) SELECT category, pv AS pv_cnt, cart AS cart_cnt, buy AS buy_cnt, {_pct('buy', 'pv')} AS conv_rate_pct FROM c")
def funnel_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.funnel(spark, valid(spark, sf_dir))


@_register(f"WITH {VALID} SELECT CAST(ts % 86400 // 3600 AS INTEGER) AS hour, count(*) AS pv, count(DISTINCT user_id) AS uv FROM valid WHERE behavior = 'pv' GROUP BY 1")
def hour_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.hour_trend(valid(spark, sf_dir))


@_register(f"""WITH {VALID}, c AS (SELECT category, item_id, count(*) AS buy_cnt FROM valid WHERE behavior = 'buy' GROUP BY ALL)
 SELECT * FROM (SELECT category, item_id, buy_cnt, CAST(rank() OVER (PARTITION BY category ORDER BY buy_cnt DESC) AS INTEGER) AS rk FROM c) WHERE rk <= 3""")
def top3_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_items(valid(spark, sf_dir))


@_register(f"WITH {VALID} SELECT user_id, count(*) AS pv FROM valid WHERE behavior = 'pv' GROUP BY user_id ORDER BY pv DESC, user_id LIMIT 10")
def top_users_pv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_users(valid(spark, sf_dir))


@_register(f"WITH {VALID} SELECT behavior, count(*) AS cnt FROM valid GROUP BY behavior")
def behavior_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.behavior_counts(valid(spark, sf_dir))


@_register(f"WITH {VALID} SELECT category, count(*) AS cnt FROM valid GROUP BY category")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.category_counts(valid(spark, sf_dir))


@_register(f"WITH {VALID} SELECT behavior, format('{{:,}}', count(*)) AS cnt_text FROM valid GROUP BY behavior")
def format_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.formatted_counts(valid(spark, sf_dir))


# Scalar functions


@_register(f"WITH {VALID} SELECT DISTINCT ts, strftime(make_timestamp(ts * 1000000), '%Y-%m-%d %H:%M:%S') AS event_time FROM valid")
def epoch_to_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch seconds as timestamps, written out in UTC."""
    return valid(spark, sf_dir).select("ts").distinct().select("ts", F.date_format(clean.local_time(F.col("ts"), "UTC"), "yyyy-MM-dd HH:mm:ss").alias("event_time"))


@_register()
def json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the Kafka messages under the fixed schema; what doesn't fit is null. No SQL: engines differ on broken JSON."""
    m = table(spark, sf_dir, "kafka_behavior")
    return m.select("topic_partition", "kafka_offset", F.from_json(F.col("value").cast("string"), sources.MESSAGE_DDL).alias("data")).select("topic_partition", "kafka_offset", "data.*")


@_register("""WITH m AS (SELECT topic_partition, kafka_offset, try(decode(value)) AS t FROM kafka_behavior), j AS (SELECT * FROM m WHERE json_valid(t) AND json_type(t) = 'OBJECT')
 SELECT topic_partition, kafka_offset, t ->> '$.userId' AS "userId", t ->> '$.itemId' AS "itemId", t ->> '$.behavior' AS behavior, CAST(t ->> '$.timestamp' AS BIGINT) AS "timestamp" FROM j
 WHERE json_type(t, '$.userId') = 'VARCHAR' AND json_type(t, '$.itemId') = 'VARCHAR' AND json_type(t, '$.behavior') = 'VARCHAR' AND json_type(t, '$.timestamp') IN ('BIGINT', 'UBIGINT')""")
def json_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages whose four fields are all there."""
    return json_parse(spark, sf_dir).dropna()


@_register(f"WITH {VALID}, c AS (SELECT DISTINCT category FROM valid) SELECT category, CAST(s AS INTEGER) AS salt, category || '_' || s AS salted_key FROM c, range(10) AS r(s)")
def explode_salt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tuning.explode_salt(valid(spark, sf_dir).select("category").distinct(), 10).withColumn("salted_key", F.concat("category", F.lit("_"), "salt"))


_DISCOUNT_CASE = "CASE category " + " ".join(f"WHEN '{k.lower()}' THEN {v}" for k, v in DISCOUNTS.items()) + " ELSE 1.0 END"


@_register(f"WITH {VALID} SELECT category, CAST({_DISCOUNT_CASE} AS DOUBLE) AS discount, count(*) AS cnt FROM valid GROUP BY ALL")
def discount_lookup_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discount from a literal map, 1.0 for categories without one."""
    found = tuning.lookup_map(valid(spark, sf_dir), values={k.lower(): v for k, v in DISCOUNTS.items()})
    return found.groupBy("category", "discount").agg(F.count(F.lit(1)).alias("cnt"))


@_register(f"WITH {VALID}, c AS (SELECT category, count(*) AS cnt FROM valid GROUP BY category) SELECT category, cnt, CAST(greatest(16, (cnt * 200 + max(cnt) OVER ()) // (2 * max(cnt) OVER ())) AS INTEGER) AS width FROM c")
def bar_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.bar_widths(valid(spark, sf_dir))


# Joins

_DIM = "dim AS (SELECT lower(category) AS category, max(discount) AS discount FROM category_discount GROUP BY 1)"


def _discounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "category_discount").select(F.lower("category").alias("category"), "discount")


@_register(f"WITH {VALID}, {_DIM} SELECT v.user_id, v.item_id, v.category, v.behavior, v.ts, coalesce(d.discount, 1.0) AS discount FROM valid v LEFT JOIN dim d ON v.category = d.category")
def discount_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its category's discount, 1.0 if there is none."""
    return tuning.lookup(valid(spark, sf_dir), _discounts(spark, sf_dir), "category", "discount")


@_register(f"WITH {VALID}, {_DIM} SELECT v.user_id, v.item_id, v.category, v.behavior, v.ts, d.discount FROM valid v JOIN dim d ON v.category = d.category")
def salted_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows joined with the discount of their category, hot categories spread over ten salts."""
    dim = _discounts(spark, sf_dir).groupBy("category").agg(F.max("discount").alias("discount"))
    log = valid(spark, sf_dir)
    # The discounts are small enough to be broadcast, but the query is to show the join of two large sides.
    return tuning.salted_join(log, dim, "category", ["user_id", "item_id", "ts"], broadcast_bytes=-1)


@_register(f"WITH {VALID} SELECT DISTINCT user_id, category FROM valid WHERE behavior = 'buy'")
def distinct_user_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.user_categories(valid(spark, sf_dir))


# Dashboard

_CATEGORY = f"""cat AS (SELECT category, count(DISTINCT ts // 86400) AS active_days, count(*) AS total_interactions, count(DISTINCT user_id) AS total_users, count(DISTINCT item_id) AS total_items,
  count(*) FILTER (behavior = 'pv') AS total_views, count(*) FILTER (behavior = 'cart') AS total_carts, count(*) FILTER (behavior = 'buy') AS total_buys FROM valid GROUP BY category),
 metrics AS (SELECT *, {_pct('total_buys', 'total_views')} AS avg_conversion_rate, CAST((total_interactions * 20000 + CAST(sum(total_interactions) OVER () AS BIGINT)) // (2 * CAST(sum(total_interactions) OVER () AS BIGINT)) AS DOUBLE) / 100 AS market_share,
  CAST(rank() OVER (ORDER BY total_interactions DESC) AS INTEGER) AS category_rank FROM cat)"""


@_register(f"WITH {VALID}, {_CATEGORY} SELECT * FROM metrics")
def category_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.category_metrics(valid(spark, sf_dir))


@_register(f"""WITH {VALID}, u AS (SELECT user_id, count(DISTINCT ts // 86400) AS active_days, count(*) AS total_behaviors, {_COUNTS}, max(ts // 86400) AS last FROM valid GROUP BY user_id),
 s AS (SELECT *, pv + 3 * fav + 5 * cart + 10 * buy AS score FROM u)
 SELECT user_id, CASE WHEN score >= 1000 THEN 'high' WHEN score >= 200 THEN 'medium' ELSE 'low' END AS user_level, active_days, total_behaviors, pv AS total_views, cart AS total_carts, buy AS total_buys,
  {_pct('buy', 'pv')} AS avg_conversion_rate, score AS user_value_score, {DAY.format('last')} AS last_active_date FROM s ORDER BY score DESC, user_id LIMIT 10""")
def top_user_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_user_metrics(valid(spark, sf_dir))


@_register(f"""WITH {VALID}, w AS (SELECT ts - ts % 300 AS s, category, count(*) AS total_events, count(DISTINCT user_id) AS unique_users, {_COUNTS} FROM valid GROUP BY ALL)
 SELECT strftime(make_timestamp(s * 1000000), '%Y-%m-%d %H:%M:%S') AS window_start, strftime(make_timestamp((s + 300) * 1000000), '%Y-%m-%d %H:%M:%S') AS window_end, category, total_events, unique_users,
  pv AS view_count, cart AS cart_count, buy AS buy_count, fav AS fav_count, {_pct('buy', 'pv')} AS conversion_rate FROM w""")
def realtime_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.realtime_metrics(valid(spark, sf_dir))


@_register(f"WITH {VALID}, {_CATEGORY} SELECT * FROM metrics ORDER BY total_interactions DESC, category LIMIT 5")
def top_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five categories with most interactions, as the dashboard shows them."""
    return category_metrics(spark, sf_dir).orderBy(F.desc("total_interactions"), "category").limit(5)


@_register(_SQL["realtime_metrics"] + " ORDER BY window_start DESC, total_events DESC, category LIMIT 12")
def latest_realtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve latest rows of realtime_metrics."""
    return realtime_metrics(spark, sf_dir).orderBy(F.desc("window_start"), F.desc("total_events"), "category").limit(12)


def _rules_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS alert_type, '{level}' AS alert_level, category, '{m}' AS metric_name, CAST({m} AS DOUBLE) AS metric_value, CAST({v} AS DOUBLE) AS threshold, concat_ws(' ', category, '{m}', '{'above' if s > 0 else 'below'}', 'threshold') AS description FROM metrics WHERE {m} {'>' if s > 0 else '<'} {v}"
        for t, m, s, v, level in reports.ALERT_RULES
    )


@_register(f"WITH {VALID}, {_CATEGORY} {_rules_sql()}")
def metric_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.metric_alerts(valid(spark, sf_dir))


@_register(f"""WITH {VALID}, c AS (SELECT {_COUNTS} FROM valid), s AS (SELECT pv, unnest([{{'n': 1, 's': 'pv', 'c': pv}}, {{'n': 2, 's': 'fav', 'c': fav}}, {{'n': 3, 's': 'cart', 'c': cart}}, {{'n': 4, 's': 'buy', 'c': buy}}]) AS x FROM c)
 SELECT CAST(x.n AS INTEGER) AS step_no, x.s AS step_name, x.c AS cnt, coalesce({_pct('x.c', 'pv')}, 0.0) AS conversion_rate FROM s""")
def behavior_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.behavior_funnel(valid(spark, sf_dir))


@_register(f"""WITH {VALID}, {_CATEGORY}, t AS (SELECT CAST(sum(total_interactions) AS BIGINT) AS total_interactions, CAST(sum(total_users) AS BIGINT) AS total_users, CAST(sum(total_buys) AS BIGINT) AS total_buys, CAST(sum(total_views) AS BIGINT) AS total_views, count(*) AS categories FROM metrics)
 SELECT *, (SELECT count(DISTINCT user_id) FROM valid) AS distinct_users, {_pct('total_buys', 'total_views')} AS avg_conversion_rate FROM t""")
def site_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.site_summary(valid(spark, sf_dir))


_WS_ENDS = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_ALERT_TIME = "trim(replace(replace(replace(alert_time, '/', '-'), 'T', ' '), 'Z', ''))"
_ALERTS = f"""SELECT DISTINCT lower({_WS_ENDS.format('alert_type')}) AS alert_type, CASE lower({_WS_ENDS.format('alert_level')}) WHEN 'warn' THEN 'warning' ELSE lower({_WS_ENDS.format('alert_level')}) END AS alert_level,
 lower(regexp_replace({_WS_ENDS.format('category')}, '\\s+', ' ', 'g')) AS category, lower({_WS_ENDS.format('metric_name')}) AS metric_name, CASE WHEN NOT isnan(metric_value) THEN metric_value END AS metric_value,
 CASE WHEN NOT isnan(threshold) THEN threshold END AS threshold, CASE WHEN length({_ALERT_TIME}) = 16 THEN {_ALERT_TIME} || ':00' ELSE {_ALERT_TIME} END AS alert_time, description FROM alert_log"""


@_register(_ALERTS)
def alert_log_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct alerts of the log in normal form."""
    return reports.clean_alerts(table(spark, sf_dir, "alert_log"))


@_register(f"SELECT * FROM ({_ALERTS}) ORDER BY {', '.join(c + ' DESC NULLS LAST' for c in ('alert_time', 'alert_type', 'category', 'metric_name', 'metric_value', 'alert_level', 'threshold', 'description'))} LIMIT 8")
def latest_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.latest_alerts(table(spark, sf_dir, "alert_log"))


# Streaming

_SLIDING = f"""WITH {VALID}, w AS (SELECT (ts - ts % 30) - 30 * k AS s, behavior, user_id FROM valid, range(2) AS r(k)),
 g AS (SELECT s, behavior, count(*) AS pv, count(DISTINCT user_id) AS uv FROM w GROUP BY ALL)
 SELECT strftime(make_timestamp(s * 1000000), '%Y-%m-%d %H:%M:%S') AS window_start, strftime(make_timestamp((s + 60) * 1000000), '%Y-%m-%d %H:%M:%S') AS window_end, behavior, pv, uv FROM g"""


def _events(df: DataFrame) -> DataFrame:
    return df.select("user_id", "behavior", sources.event_time(F.col("ts")).alias("event_time"))


def _flat(df: DataFrame) -> DataFrame:
    at = lambda x: reports.clock(F.unix_timestamp(F.col(f"window.{x}")))
    return df.select(at("start").alias("window_start"), at("end").alias("window_end"), "behavior", "pv", "uv")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid rows as a stream, from a table of the shared folder; so repeated rows are gone, which a stream could only drop with unbounded state."""
    path = new_path(spark, "events")
    valid(spark, sf_dir).write.parquet(path)  # a folder that nothing else writes to
    return _events(sources.file_stream(spark, path))


@_register(_SLIDING)
def sliding_window_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(windows.sliding_windows_batch(_events(valid(spark, sf_dir))))


@_register(f"""WITH f AS (SELECT string_split(line, ',') AS f FROM behavior_csv_lines WHERE line IS NOT NULL)
 SELECT f[1] AS "userId", f[2] AS "itemId", f[3] AS category, f[4] AS behavior, TRY_CAST(trim(f[5]) AS BIGINT) AS "timestamp" FROM f WHERE len(f) = 5 AND regexp_full_match(trim(f[5], ' ' || chr(9) || chr(10) || chr(13)), '[+-]?[0-9]+')""")
def stream_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines parsed on a stream: five fields and a whole number, nothing else is asked."""
    stream = sources.parse_lines(sources.file_stream(spark, f"{sf_dir}/behavior_csv_lines.parquet"), "line").drop("event_time")
    return windows.drain(spark, stream, "append")


@_register()
def stream_kafka_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages decoded on a stream."""
    stream = sources.decode_messages(sources.file_stream(spark, f"{sf_dir}/kafka_behavior.parquet")).drop("event_time")
    return windows.drain(spark, stream, "append")


@_register(f'SELECT "userId", "itemId", behavior, "timestamp" FROM ({_SQL["json_whole"]})')
def stream_json_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of a stream whose four fields are all there."""
    return stream_kafka_json(spark, sf_dir).dropna()


@_register(_SLIDING)
def stream_pvuv_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and visitors per sliding window in update mode with a watermark; the last value of each window."""
    rows = windows.visitor_rows(_event_stream(spark, sf_dir), watermark="10 seconds")
    return _flat(windows.visitors(windows.drain(spark, rows, "update", ["window", "behavior", "user_id"])))


@_register(_SLIDING)
def stream_pvuv_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(windows.visitors(windows.drain(spark, windows.visitor_rows(_event_stream(spark, sf_dir)), "complete")))


@_register()
def stream_uv_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As stream_pvuv_complete with approximate visitors."""
    return _flat(windows.drain(spark, windows.sliding_windows(_event_stream(spark, sf_dir), approximate=True), "complete"))


# Graph

_CLASSES = f"""{VALID}, uc AS (SELECT DISTINCT user_id, category FROM valid WHERE behavior = 'buy'), sets AS (SELECT user_id, list_sort(list(category)) AS categories FROM uc GROUP BY user_id),
 cls AS (SELECT categories, min(user_id) AS class_id, count(*) AS members FROM sets GROUP BY categories), member AS (SELECT user_id, class_id FROM sets JOIN cls USING (categories)),
 flat AS (SELECT class_id, members, unnest(categories) AS category FROM cls)"""
_EDGES = f"""{_CLASSES}, edge AS (SELECT a.class_id AS src, b.class_id AS dst, count(*) AS weight, CASE WHEN a.class_id = b.class_id THEN a.members * (a.members - 1) // 2 ELSE a.members * b.members END AS links
  FROM flat a JOIN flat b ON a.category = b.category AND a.class_id <= b.class_id GROUP BY a.class_id, b.class_id, a.members, b.members)"""
_DEGREE = f"""{_EDGES}, arc AS (SELECT e.src, e.dst, c.members - CASE WHEN e.src = e.dst THEN 1 ELSE 0 END AS n FROM (SELECT src, dst FROM edge UNION ALL SELECT dst, src FROM edge WHERE src <> dst) e JOIN cls c ON c.class_id = e.src),
 deg AS (SELECT dst AS class_id, CAST(sum(n) AS BIGINT) AS degree FROM arc WHERE n > 0 GROUP BY dst)"""


def _classes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return graph.classes(valid(spark, sf_dir))


@_register(f"WITH {VALID} SELECT DISTINCT user_id FROM valid")
def graph_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.vertices(valid(spark, sf_dir)).select("user_id")


@_register(f"WITH {VALID}, sold AS (SELECT DISTINCT user_id AS end_id, user_id FROM valid WHERE behavior = 'buy'), known AS (SELECT DISTINCT user_id FROM valid WHERE behavior = 'pv') SELECT s.end_id, coalesce(k.user_id, 'Unknown') AS user_id FROM sold s LEFT JOIN known k ON s.user_id = k.user_id")
def graph_unknown_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buyers as ends of links, over vertices that are viewers only: an end that has no vertex is called Unknown."""
    log = valid(spark, sf_dir)
    ends = graph.vertices(log.filter("behavior = 'buy'")).select("vertex_id", F.col("user_id").alias("end_id"))
    return graph.with_unknown(ends, graph.vertices(log.filter("behavior = 'pv'"))).select("end_id", "user_id")


@_register(f"WITH {VALID} SELECT count(DISTINCT user_id) AS users, count(DISTINCT user_id) AS ids, CAST(0 AS BIGINT) AS negative FROM valid")
def graph_vertex_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertex ids are the users' own: as many different ones as users, none below 0."""
    return graph.vertices(valid(spark, sf_dir)).agg(F.count(F.lit(1)).alias("users"), F.countDistinct("vertex_id").alias("ids"), F.sum((F.col("vertex_id") < 0).cast("bigint")).alias("negative"))


@_register(f"WITH {_CLASSES} SELECT user_id, class_id FROM member")
def graph_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buyers and the class of all who bought in the same set of categories."""
    return _classes(spark, sf_dir)[0]


@_register(f"WITH {_EDGES} SELECT src, dst, weight, links FROM edge")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between users as edges between their classes, with the number of common categories; graph_classes has the members."""
    return graph.edges(_classes(spark, sf_dir)[1])


@_register(f"WITH {_EDGES} SELECT (SELECT count(DISTINCT user_id) FROM valid) AS vertices, (SELECT CAST(sum(links) AS BIGINT) FROM edge) AS edges")
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of users and of linked pairs of users."""
    log = valid(spark, sf_dir)
    links = graph.count_links(graph.classes(log)[1])
    return log.agg(F.countDistinct("user_id").alias("vertices")).join(F.broadcast(links), F.lit(True))  # one row each


def _degree(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    members, class_table = _classes(spark, sf_dir)
    return members.join(graph.degrees(class_table), "class_id").select("user_id", F.col("degree").alias(name))


@_register(f"WITH {_DEGREE} SELECT user_id, degree AS out_degree FROM member JOIN deg USING (class_id)")
def graph_out_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _degree(spark, sf_dir, "out_degree")


@_register(f"WITH {_DEGREE} SELECT user_id, degree AS out_degree FROM member JOIN deg USING (class_id) ORDER BY degree DESC, user_id LIMIT 5")
def graph_top_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _degree(spark, sf_dir, "out_degree").orderBy(F.desc("out_degree"), "user_id").limit(5)


@_register(f"WITH {_DEGREE} SELECT user_id, degree AS in_degree FROM member JOIN deg USING (class_id)")
def graph_in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links count in both directions, so this equals graph_out_degree."""
    return _degree(spark, sf_dir, "in_degree")


_COMPONENTS = f"""WITH RECURSIVE {_CLASSES}, pairs AS (SELECT DISTINCT a.category AS x, b.category AS y FROM uc a JOIN uc b ON a.user_id = b.user_id),
 reach(x, y) AS (SELECT x, y FROM pairs UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x),
 low AS (SELECT r.x AS category, min(u.user_id) AS component FROM reach r JOIN uc u ON u.category = r.y GROUP BY r.x),
 comp AS (SELECT v.user_id, coalesce(min(l.component), v.user_id) AS component FROM (SELECT DISTINCT user_id FROM valid) v LEFT JOIN uc u ON u.user_id = v.user_id LEFT JOIN low l ON l.category = u.category GROUP BY v.user_id)"""


@_register(f"{_COMPONENTS} SELECT user_id, component FROM comp")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.user_components(valid(spark, sf_dir))


@_register(f"{_COMPONENTS} SELECT component, count(*) AS size FROM comp GROUP BY component")
def graph_component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.component_sizes(graph_components(spark, sf_dir))


@_register(f"{_COMPONENTS} SELECT component, count(*) AS size FROM comp GROUP BY component ORDER BY size DESC, component LIMIT 5")
def graph_top_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest components."""
    return graph_component_sizes(spark, sf_dir).limit(5)


_RANKS = f"""WITH RECURSIVE {_DEGREE}, pr(it, class_id, rank) AS (SELECT 0, class_id, CAST(1.0 AS DOUBLE) FROM deg
  UNION ALL SELECT p.it + 1, a.dst, 0.15 + 0.85 * sum(p.rank / d.degree * a.n) FROM pr p JOIN deg d ON d.class_id = p.class_id JOIN arc a ON a.src = p.class_id AND a.n > 0 WHERE p.it < {RANK_ROUNDS} GROUP BY p.it, a.dst),
 final AS (SELECT m.user_id, coalesce(p.rank, 0.15) AS rank FROM member m LEFT JOIN pr p ON p.class_id = m.class_id AND p.it = {RANK_ROUNDS}),
 total AS (SELECT count(DISTINCT v.user_id) AS n, (SELECT sum(rank) FROM final) + 0.15 * (count(DISTINCT v.user_id) - (SELECT count(*) FROM final)) AS t FROM valid v),
 scaled AS (SELECT user_id, rank * n / t AS rank FROM final, total)"""


def _ranks(spark: SparkSession, sf_dir: str, n: int | None) -> DataFrame:
    log = valid(spark, sf_dir)
    members, class_table = graph.classes(log)
    users = log.select("user_id").distinct().count()
    return graph.ranked_users(graph.pagerank(class_table, None, users, RANK_ROUNDS, RANK_TOLERANCE), members, n)


@_register(f"{_RANKS} SELECT user_id, round(rank, 4) AS rank FROM scaled")
def graph_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PageRank of every buyer, run until it has converged."""
    return _ranks(spark, sf_dir, None).withColumn("rank", F.round("rank", 4))


@_register(f"{_RANKS} SELECT user_id, round(rank, 4) AS rank FROM scaled ORDER BY round(scaled.rank, 6) DESC, user_id LIMIT 10")
def graph_pagerank_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranks(spark, sf_dir, 10).withColumn("rank", F.round("rank", 4))


# Models

_FEATURES = f"""{VALID}, feat AS (SELECT user_id, count(*) FILTER (behavior = 'pv') AS pv_cnt, count(*) FILTER (behavior = 'cart') AS cart_cnt, count(*) FILTER (behavior = 'fav') AS fav_cnt,
  count(*) FILTER (behavior = 'buy') AS buy_cnt, count(DISTINCT category) AS category_diversity, count(DISTINCT item_id) AS item_diversity FROM valid GROUP BY user_id),
 lab AS (SELECT *, CASE WHEN buy_cnt > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label FROM feat)"""


@_register(f"WITH {_FEATURES} SELECT * FROM lab")
def user_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return propensity.user_features(valid(spark, sf_dir))


@_register(f"WITH {_FEATURES} SELECT label, count(*) AS cnt FROM lab GROUP BY label")
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_features(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("cnt"))


@_register(f"""WITH {_FEATURES}, n AS (SELECT count(*)::DOUBLE AS a, greatest(count(*) FILTER (label = 0), 1) AS neg, greatest(count(*) FILTER (label = 1), 1) AS pos FROM lab)
 SELECT user_id, label, round(a / (2 * CASE WHEN label = 1 THEN pos ELSE neg END), 9) AS class_weight FROM lab, n""")
def user_class_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return propensity.with_class_weight(materialize(user_features(spark, sf_dir), "features")).select("user_id", "label", F.round("class_weight", 9).alias("class_weight"))


def _data(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    data = materialize(propensity.with_class_weight(materialize(user_features(spark, sf_dir), "features")), "weighted")
    return propensity.split(data)


@_register()
def ml_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and purchasers of the training and the test part."""
    parts = zip(("train", "test"), _data(spark, sf_dir))
    counted = [p.agg(F.count(F.lit(1)).alias("cnt"), F.sum("label").alias("buyers")).select(F.lit(n).alias("part"), "cnt", "buyers") for n, p in parts]
    return counted[0].unionByName(counted[1])


@_register(f"WITH {_FEATURES} SELECT count(*) AS cnt, CAST(sum(label) AS BIGINT) AS buyers, CAST(0 AS BIGINT) AS in_both, TRUE AS near_four_fifths FROM lab")
def ml_split_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and purchasers of both parts together, users in both, and whether the training part has about four fifths."""
    train, test = _data(spark, sf_dir)
    both = train.select("user_id", "label", F.lit(1).alias("train")).unionByName(test.select("user_id", "label", F.lit(0).alias("train")))
    users = both.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("label").alias("label"), F.max("train").alias("train"))
    share = F.avg("train")
    return users.agg(F.count(F.lit(1)).alias("cnt"), F.sum("label").cast("bigint").alias("buyers"), F.sum((F.col("n") > 1).cast("bigint")).alias("in_both"), ((share > 0.75) & (share < 0.85)).alias("near_four_fifths"))


def _predictions(spark: SparkSession, sf_dir: str, forest: bool) -> DataFrame:
    train, test = _data(spark, sf_dir)
    return (propensity.random_forest() if forest else propensity.logistic_regression()).fit(train).transform(test)


@_register()
def ml_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predictions(spark, sf_dir, False).select("user_id", "label", "prediction")


@_register()
def ml_rf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predictions(spark, sf_dir, True).select("user_id", "label", "prediction")


@_register()
def ml_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and area under ROC of both models."""
    train, test = _data(spark, sf_dir)
    rows = [(n, *propensity.metrics(p.fit(train).transform(test)).values()) for n, p in (("logistic_regression", propensity.logistic_regression()), ("random_forest", propensity.random_forest()))]
    return spark.createDataFrame(rows, "model string, accuracy double, auc double")


@_register()
def ml_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return propensity.confusion(_predictions(spark, sf_dir, True))


# Tuning


@_register(f"WITH {VALID}, c AS (SELECT count(*) AS cnt FROM valid WHERE behavior = 'buy') SELECT l AS level, cnt FROM c, (VALUES ('MEMORY_ONLY'), ('MEMORY_AND_DISK')) AS t(l)")
def cache_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases counted from a cache at two storage levels."""
    bought = valid(spark, sf_dir).filter("behavior = 'buy'")
    rows = [(n, tuning.timed_count(bought, level)[0]) for n, level in (("MEMORY_ONLY", StorageLevel.MEMORY_ONLY), ("MEMORY_AND_DISK", StorageLevel.MEMORY_AND_DISK))]
    return spark.createDataFrame(rows, "level string, cnt bigint")


@_register()
def partition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions of the log as read, repartitioned to four and coalesced to one."""
    log = table(spark, sf_dir, "user_behavior_log")
    rows = [(n, tuning.partitions(d)) for n, d in (("read", log), ("repartition", log.repartition(4)), ("coalesce", log.coalesce(1)))]
    return spark.createDataFrame(rows, "step string, partitions int")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
