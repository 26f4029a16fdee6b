"""Queries of the general data-pipeline operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import features, sessions
from tallyloom.operators.valid import valid_rows
from tallyloom.plans.sqltext import VALID
from tallyloom.plans.tables import table, valid
from tallyloom.schema import BEHAVIORS
from tallyloom.session import materialize

SESSION_GAP_S = 1800


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user, cut at gaps of more than 1,800 seconds."""
    return sessions.cut_sessions(sessions.gap_tree(valid(spark, sf_dir)), SESSION_GAP_S).select("user_id", "session_start", "session_end")


def p1_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with duration and actions at three gap settings, from one tree."""
    tree = materialize(sessions.gap_tree(valid(spark, sf_dir)), "gap-tree")
    out = None
    for gap in (300, SESSION_GAP_S, 7200):
        part = sessions.cut_sessions(tree, gap).withColumn("gap_s", F.lit(gap).cast("bigint"))
        out = part if out is None else out.unionByName(part)
    return out


def p4_user_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user: actions, active days and seconds since the last action, in all, by behavior and by behavior and category."""
    rows = valid_rows(table(spark, sf_dir, "user_behavior_log"))
    return features.feature_table(rows, unique_by=rows.columns)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_sessions, p4_user_features)}


def _sessions_sql(gap: int) -> str:
    return f"""SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, max(ts) - min(ts) AS duration_s, count(*) AS actions, CAST({gap} AS BIGINT) AS gap_s FROM (
  SELECT user_id, ts, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM (
   SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= {gap} THEN 0 ELSE 1 END AS starts FROM valid)) GROUP BY user_id, k"""


#: The categories of the test log in normal form.
_CATEGORIES = """aquariums,baby care,bakery,beauty,bedding,board games,books,calendars,camping,car parts,chargers,climbing,clocks,clothing,comics,cook books,craft yarn,curtains,
cycling,door locks,drones,electronics,eyewear,fishing,food,footwear,fresh fruit,frozen meals,garden tools,hair care,hats,headphones,keyboards,kitchenware,lighting,luggage,maps,
monitors,motor oil,musical gear,paint,perfume,pet supplies,phone cases,puzzles,rugs,skin care,smart home,snack boxes,socks,spices,sports,stationery,storage bins,swimwear,
tea and coffee,toys,vitamins,watches,winter coats,yoga mats""".replace("\n", "").split(",")


def _features_sql() -> str:
    types = ["all", *BEHAVIORS, *(f"{b}/{c}" for b in BEHAVIORS for c in _CATEGORIES)]
    columns = ", ".join(
        f"""coalesce(max(n) FILTER (event_type = '{t}'), 0) AS "{t}_n", coalesce(max(days) FILTER (event_type = '{t}'), 0) AS "{t}_days", max(since_s) FILTER (event_type = '{t}') AS "{t}_since_s\""""
        for t in types
    )
    return f"""WITH {VALID}, base AS (SELECT user_id, ts, unnest(['all', behavior, behavior || '/' || category]) AS event_type FROM valid),
 typed AS (SELECT user_id, event_type, count(*) AS n, count(DISTINCT ts // 86400) AS days, (SELECT max(ts) FROM valid) - max(ts) AS since_s FROM base GROUP BY ALL)
 SELECT user_id, {columns} FROM typed GROUP BY user_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {VALID} SELECT user_id, session_start, session_end FROM ({_sessions_sql(SESSION_GAP_S)})",
        "p1_sessions": f"WITH {VALID} " + " UNION ALL ".join(_sessions_sql(g) for g in (300, SESSION_GAP_S, 7200)),
        "p4_user_features": _features_sql(),
    }
