"""Queries of the llm operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.time import day_number, day_text, week_start
from tallyloom.llm import distinct, leakage, packing, pairs, pii, topn
from tallyloom.operators.valid import valid_rows
from tallyloom.plans.sqltext import DAY, VALID
from tallyloom.plans.tables import table, valid
from tallyloom.session import materialize

#: Distinct users: within 1 % at five standard errors.
P2_ERROR, P2_SIGMAS = 0.01, 5.0
P2_GROUPS = ["event_day", "category", "behavior"]


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Repeated rows set the same bit again, so they needn't be removed first.
    return valid_rows(table(spark, sf_dir, "user_behavior_log")).select(day_number(F.col("ts")).alias("day"), "category", "behavior", "user_id")


def _user_bitmaps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    # Spellings of one id count apart here, which only makes the bitmaps a little larger, and a single column is read.
    bits = distinct.sized_bits(table(spark, sf_dir, "user_behavior_log"), "userId", P2_ERROR, P2_SIGMAS)
    found = distinct.bitmaps(_users(spark, sf_dir), ["day", "category", "behavior"], "user_id", bits)
    return found.select(day_text(F.col("day")).alias("event_day"), "day", "category", "behavior", distinct.WORD_NO, distinct.WORD_BITS), bits


def p2_distinct_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users per day, category and behavior and every combination of them, merged level by level from one set of partial results."""
    partials, bits = _user_bitmaps(spark, sf_dir)
    found = distinct.cube_estimates(materialize(partials.drop("day"), "user-bitmaps"), P2_GROUPS, bits, P2_SIGMAS)
    return found.withColumn("estimate", F.round("estimate", 4)).withColumn("error_bound", F.round("error_bound", 4))


def _within() -> Column:
    # An estimate of a few users can be one off where two of them share a bit.
    return (F.abs(F.col("estimate") - F.col("users")) <= F.greatest(F.col("error_bound"), F.lit(1.0))).alias("within_bound")


def p2_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True numbers of distinct users of every combination, and whether p2_distinct_users is within its bound of each."""
    named = materialize(_users(spark, sf_dir).distinct().select(day_text(F.col("day")).alias("event_day"), "category", "behavior", "user_id"), "group-users")
    levels = None
    for mask in range(8):
        kept = [g for i, g in enumerate(P2_GROUPS) if mask >> i & 1]
        part = named.groupBy(*kept).agg(F.countDistinct("user_id").alias("users")).filter("users > 0")
        part = part.select(F.lit("+".join(kept)).alias("level"), *[F.col(g) if g in kept else F.lit(None).cast("string").alias(g) for g in P2_GROUPS], "users")
        levels = part if levels is None else levels.unionByName(part)
    same = F.lit(True)
    for c in ("level", *P2_GROUPS):
        same = same & F.col(f"t.{c}").eqNullSafe(F.col(f"e.{c}"))
    both = levels.alias("t").join(p2_distinct_users(spark, sf_dir).alias("e"), same, "full")
    return both.select(*[F.coalesce(f"t.{c}", f"e.{c}").alias(c) for c in ("level", *P2_GROUPS)], "users", _within())


def p2_trailing_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users of each behavior over unions of days: the three days that end with each day, from partial results per day; the true number, and whether the estimate is within its
    bound of it."""
    partials, bits = _user_bitmaps(spark, sf_dir)
    daily = materialize(distinct.merge(partials, ["day", "behavior"]), "daily-bitmaps")
    ends = lambda df: df.withColumn("day", F.explode(F.array(*[F.col("day") + i for i in range(3)]))).join(daily.select("day").distinct(), "day", "left_semi")
    found = distinct.estimate(distinct.merge(ends(daily), ["day", "behavior"]), ["day", "behavior"], bits, P2_SIGMAS)
    true = ends(_users(spark, sf_dir).select("day", "behavior", "user_id").distinct()).groupBy("day", "behavior").agg(F.countDistinct("user_id").alias("users"))
    return found.join(true, ["day", "behavior"], "full").select(day_text(F.col("day")).alias("last_day"), "behavior", "users", _within())


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The up to ten items most bought per day and category."""
    return _best_items(spark, sf_dir).select("event_day", "category", "item_id")


def _best_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    bought = valid(spark, sf_dir).filter("behavior = 'buy'").groupBy(day_number(F.col("ts")).alias("day"), "category", "item_id").agg(F.count(F.lit(1)).alias("purchases"))
    best = topn.top_n(bought, ["day", "category"], "item_id", "purchases", 10)
    return best.select(day_text(F.col("day")).alias("event_day"), "category", "item_id", "purchases", "rank")


def p3_best_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p3_found, with purchases and rank."""
    return _best_items(spark, sf_dir)


def _basket_rows(log: DataFrame, item: str) -> DataFrame:
    day = day_number(F.col("ts"))
    return (
        log.filter("behavior = 'buy'")
        .select(week_start(day).alias("week"), F.concat_ws("|", "user_id", day.cast("string")).alias("basket"), F.col(item).alias("item"))
        .distinct()
        .select(day_text(F.col("week")).alias("period"), "basket", "item", F.lit(1).alias("op"))
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of items in at least five baskets of a week, ten times as often as chance. The log is taken in as it came: first what arrived on the day of the action, then the late
    rows as changes to the baskets stored."""
    log = valid_rows(table(spark, sf_dir, "user_behavior_log"), keep=("arrived_at",)).filter("behavior = 'buy'")
    day = day_number(F.col("ts"))
    late = F.coalesce(F.unix_date(F.to_date("arrived_at")) > day, F.lit(True))
    rows = log.select(week_start(day).alias("week"), F.concat_ws("|", "user_id", day.cast("string")).alias("basket"), F.col("item_id").alias("item"), late.alias("late"))
    # A basket is a set, so repeated rows of the log go here too.
    rows = materialize(rows.groupBy("week", "basket", "item").agg(F.min("late").alias("late")).select(day_text(F.col("week")).alias("period"), "basket", "item", F.lit(1).alias("op"), "late"), "basket-rows")
    store = pairs.PairStore(spark)
    store.apply(rows.filter("not late"))
    store.apply(rows.filter("late"))
    return store.scores(min_count=5, min_lift=10).select(F.col("period").alias("week_start"), "item_a", "item_b")


def p5_category_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baskets and lift of every pair of categories per week."""
    store = pairs.PairStore(spark)
    store.apply(_basket_rows(valid(spark, sf_dir), "category"))
    return store.scores().select(F.col("period").alias("week_start"), F.col("item_a").alias("category_a"), F.col("item_b").alias("category_b"), "baskets", "n_a", "n_b", "n_ab", F.round("lift", 6).alias("lift"))


def p5_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item pairs with their counts, built from three batches: purchases of even seconds; those of odd seconds, with a fifth of the first batch's items taken out again;
    and these put back. Every batch changes baskets that are stored already, and the result must be that of all rows at once."""
    rows = valid(spark, sf_dir).filter("behavior = 'buy'")
    store = pairs.PairStore(spark)
    early, late = _basket_rows(rows.filter("ts % 2 = 0"), "item_id"), _basket_rows(rows.filter("ts % 2 = 1"), "item_id")
    again = early.filter(F.pmod(F.xxhash64("item"), F.lit(5)) == 0)
    store.apply(early)
    store.apply(late.unionByName(again.withColumn("op", F.lit(-1))))
    store.apply(again)
    return store.scores(min_count=2, min_lift=2).select(F.col("period").alias("week_start"), "item_a", "item_b", "baskets", "n_a", "n_b", "n_ab", F.round("lift", 6).alias("lift"))


P6_CAPACITY = 2048


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container and place of every document, 2,048 tokens to a container."""
    sizes = materialize(packing.token_sizes(table(spark, sf_dir, "documents")), "token-sizes")
    return packing.pack(sizes, P6_CAPACITY)


def p6_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of p6_containers: documents placed, documents cut although they fit, containers that are too full or whose places have a gap, and whether at most a thousandth, or one, more
    containers are in use than the tokens fill."""
    placed = materialize(p6_containers(spark, sf_dir), "containers")
    docs = placed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("n"))
    by_doc = docs.agg(F.count(F.lit(1)).alias("documents"), F.sum((F.col("pieces") != F.greatest(F.ceil(F.col("n") / P6_CAPACITY), F.lit(1))).cast("bigint")).alias("wrongly_cut"))
    full = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("items"), F.countDistinct("place").alias("places"), F.max("place").alias("last"))
    by_container = full.agg(
        F.sum((F.col("n") > P6_CAPACITY).cast("bigint")).alias("overfull"), F.sum(((F.col("places") != F.col("items")) | (F.col("last") != F.col("items") - 1)).cast("bigint")).alias("with_gaps"),
        (F.count(F.lit(1)) <= F.greatest(F.ceil(F.sum("n") / P6_CAPACITY) + 1, F.ceil(F.sum("n") / P6_CAPACITY * 1.001))).alias("near_bound"),
    )
    return by_doc.join(F.broadcast(by_container), F.lit(True))  # one row each


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that carry text of evaluation items."""
    return p7_passages(spark, sf_dir).filter("nth = 0").select("doc_id", "eval_id")


def p7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of each item in each document, with its place, words and edits."""
    return leakage.leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of personal information in the documents."""
    return pii.personal_spans(table(spark, sf_dir, "documents")).select("doc_id", "start_pos", "kind")


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with typed placeholders in place of personal information."""
    return pii.redacted(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (p2_distinct_users, p2_checked, p2_trailing_users, p3_found, p3_best_items, p5_found, p5_category_pairs, p5_incremental, p6_containers, p6_summary, p7_found, p7_passages, p8_found, p8_redacted)
    }


def _pairs_sql(item: str, names: tuple[str, str], where: str, columns: str) -> str:
    a, b = names
    return f"""WITH {VALID},
 members AS (SELECT DISTINCT ts // 86400 - (ts // 86400 + 3) % 7 AS week, user_id, ts // 86400 AS day, {item} AS item FROM valid WHERE behavior = 'buy'),
 weeks AS (SELECT week, count(DISTINCT (user_id, day)) AS baskets FROM members GROUP BY week),
 singles AS (SELECT week, item, count(*) AS n FROM members GROUP BY ALL),
 both_ AS (SELECT x.week, x.item AS {a}, y.item AS {b}, count(*) AS n_ab FROM members x JOIN members y ON x.week = y.week AND x.user_id = y.user_id AND x.day = y.day AND x.item < y.item GROUP BY ALL)
 SELECT {DAY.format('p.week')} AS week_start, {a}, {b}{columns}
 FROM both_ p JOIN weeks w ON p.week = w.week JOIN singles i ON i.week = p.week AND i.item = p.{a} JOIN singles j ON j.week = p.week AND j.item = p.{b} {where}"""


def oracle_sql() -> dict[str, str]:
    best = f"""WITH {VALID}, counts AS (SELECT {DAY.format('ts // 86400')} AS event_day, category, item_id, count(*) AS purchases FROM valid WHERE behavior = 'buy' GROUP BY ALL),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY event_day, category ORDER BY purchases DESC, item_id) AS rank FROM counts)"""
    scored = ", w.baskets AS baskets, i.n AS n_a, j.n AS n_b, n_ab, round(n_ab::DOUBLE * w.baskets / (i.n::DOUBLE * j.n), 6) AS lift"
    levels = ["event_day", "category", "behavior"]
    sets = ", ".join("(" + ", ".join(g for i, g in enumerate(levels) if mask >> i & 1) + ")" for mask in range(8))
    level = "concat_ws('+', " + ", ".join(f"CASE WHEN grouping({g}) = 0 THEN '{g}' END" for g in levels) + ")"
    return {
        "p2_checked": f"""WITH {VALID}, users AS (SELECT {DAY.format('ts // 86400')} AS event_day, category, behavior, user_id FROM valid)
 SELECT {level} AS level, event_day, category, behavior, count(DISTINCT user_id) AS users, TRUE AS within_bound FROM users GROUP BY GROUPING SETS ({sets}) HAVING count(*) > 0""",
        "p2_trailing_users": f"""WITH {VALID}, users AS (SELECT DISTINCT ts // 86400 AS day, behavior, user_id FROM valid), days AS (SELECT DISTINCT day FROM users)
 SELECT {DAY.format('d.day')} AS last_day, behavior, count(DISTINCT user_id) AS users, TRUE AS within_bound FROM days d JOIN users u ON u.day BETWEEN d.day - 2 AND d.day GROUP BY d.day, behavior""",
        "p3_found": f"{best} SELECT event_day, category, item_id FROM ranked WHERE rank <= 10",
        "p3_best_items": f"{best} SELECT event_day, category, item_id, purchases, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10",
        "p5_found": _pairs_sql("item_id", ("item_a", "item_b"), "WHERE n_ab >= 5 AND n_ab * w.baskets >= 10 * i.n * j.n", ""),
        "p5_category_pairs": _pairs_sql("category", ("category_a", "category_b"), "", scored),
        "p6_summary": "SELECT count(*) AS documents, CAST(0 AS BIGINT) AS wrongly_cut, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS with_gaps, TRUE AS near_bound FROM documents",
        "p5_incremental": _pairs_sql("item_id", ("item_a", "item_b"), "WHERE n_ab >= 2 AND n_ab * w.baskets >= 2 * i.n * j.n", scored),
    }
