"""One row of features per entity from events: counts, active days and recency in all and for each event type.

Events are counted by entity, type and day and stored once, bucketed by entity. Event types are cut into blocks; every block is aggregated by entity from that store and joined onto
the table of all entities, which comes from the same store. As all sides have the buckets' partitioning, no block and no join shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.time import day_number
from tallyloom.session import bucketed

ALL = "all"


def _day() -> list[Column]:
    """The features of rows of one day."""
    return [F.sum("n").alias("n"), F.max("last_ts").alias("last_ts")]


def _days() -> list[Column]:
    """The features of rows of one day each."""
    return [*_day(), F.count(F.lit(1)).alias("days")]


def daily_rows(log: DataFrame, unique_by: list[str] | None = None) -> DataFrame:
    """user_id, behavior, pair, day, n, last_ts of a log of user_id, behavior, category, ts; pair is ``behavior/category``, null for a null category. Rows with a null entity, behavior or
    time are left out. unique_by: columns, user_id and ts among them, in which rows alike count once.

    The first shuffle splits each entity by minute, so an entity with a third of all rows is spread over as many tasks as it has minutes; what is left after
    counting by (entity, minute, behavior, category) goes to the entity's one task.
    """
    minute = F.call_function("div", F.col("ts") - F.pmod("ts", F.lit(60).cast("bigint")), F.lit(60).cast("bigint"))
    rows = log.filter("user_id is not null and behavior is not null and ts is not null").withColumn("_minute", minute).repartition("user_id", "_minute")
    if unique_by:
        rows = rows.select(*unique_by, *[c for c in ("user_id", "behavior", "category", "ts", "_minute") if c not in unique_by]).distinct()
    counted = rows.groupBy("user_id", "_minute", "behavior", "category").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))
    buckets = max(1, int(log.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    daily = counted.repartition(buckets, "user_id").groupBy("user_id", "behavior", "category", day_number(F.col("last_ts")).alias("day")).agg(*_day())
    return daily.select("user_id", "behavior", F.concat("behavior", F.lit("/"), "category").alias("pair"), "day", "n", "last_ts")


def _of_all(daily: DataFrame) -> DataFrame:
    return daily.groupBy("user_id", "day").agg(*_day()).groupBy("user_id").agg(*_days())


def _of_behaviors(daily: DataFrame) -> DataFrame:
    days = daily.groupBy("user_id", "behavior", "day").agg(*_day()).groupBy("user_id", "behavior").agg(*_days())
    return days.withColumnRenamed("behavior", "event_type")


def _of_pairs(daily: DataFrame) -> DataFrame:
    days = daily.filter("pair is not null").groupBy("user_id", "behavior", "pair").agg(*_days())
    return days.select("user_id", F.col("pair").alias("event_type"), "n", "days", "last_ts")


def type_rows(log: DataFrame, unique_by: list[str] | None = None) -> DataFrame:
    """user_id, event_type, n, days, last_ts: one row for each entity and each type that it has. Types are ``all``, each behavior, and each ``behavior/category``; a null category counts
    towards ``all`` and the behavior only. Else as daily_rows."""
    daily = bucketed(daily_rows(log, unique_by), "daily", "user_id")
    every = _of_all(daily).select("user_id", F.lit(ALL).alias("event_type"), "n", "days", "last_ts")
    return every.unionByName(_of_behaviors(daily)).unionByName(_of_pairs(daily))


#: Event types at most; they become columns, hence more are an error rather than a cut result.
MOST_TYPES = 20_000


def event_types(rows: DataFrame, most: int = MOST_TYPES) -> list[str]:
    """The types that occur, sorted."""
    found = [r[0] for r in rows.select("event_type").distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} event types can't become columns")
    return sorted(found)


def _names(kinds: DataFrame) -> tuple[list[str], list[str]]:
    """Behaviors and pairs, sorted, of rows single and event_type."""
    found = kinds.limit(MOST_TYPES + 1).collect()
    if len(found) > MOST_TYPES:
        raise ValueError(f"more than {MOST_TYPES} event types can't become columns")
    return sorted(r["event_type"] for r in found if r["single"]), sorted(r["event_type"] for r in found if not r["single"])


def feature_table(log: DataFrame, block_size: int = 100, as_of: int | None = None, types: list[str] | None = None, unique_by: list[str] | None = None) -> DataFrame:
    """One row per entity: user_id and, for each type t, ``t_n`` (actions, 0 if none), ``t_days`` (active days, 0 if none) and ``t_since_s`` (seconds from the last
    action to as_of, null if none).

    as_of: epoch seconds, by default the latest action of all. types: the columns to make, by default all that occur. unique_by: as in type_rows. An empty log gives
    no rows.
    """
    daily = bucketed(daily_rows(log, unique_by), "daily", "user_id")
    kinds = F.array_compact(F.array(F.struct(F.lit(True).alias("single"), F.col("behavior").alias("event_type")), F.when(F.col("pair").isNotNull(), F.struct(F.lit(False).alias("single"), F.col("pair").alias("event_type")))))
    found = daily.select("behavior", "pair").distinct().select("behavior", F.explode(kinds).alias("k")).select("k.*", F.when(~F.col("k.single"), F.col("behavior")).alias("of")).distinct()
    behaviors, pairs = _names(found)
    if len({ALL, *behaviors, *pairs}) < 1 + len(behaviors) + len(pairs):
        raise ValueError("two event types have one name")
    names = sorted([ALL, *behaviors, *pairs]) if types is None else list(types)
    if as_of is None:
        as_of = daily.agg(F.max("last_ts")).first()[0] or 0
    table = _of_all(daily).select("user_id", F.create_map(F.lit(ALL), F.struct("n", "days", "last_ts")).alias("_block0"))
    blocks = [[t for t in names if t == ALL]]
    # A block's features travel as one map of at most block_size entries: joining some hundred columns at a time would make methods too large for the JIT compiler.
    for level, of in ((set(behaviors), _of_behaviors), (None, _of_pairs)):
        own = [t for t in names if t != ALL and (t in level if level is not None else t not in behaviors)]
        for i in range(0, len(own), block_size):
            block = own[i : i + block_size]
            wanted = daily.filter(F.col("behavior").isin(block) if level is not None else F.col("pair").isin(block))
            entries = F.map_from_entries(F.collect_list(F.struct("event_type", F.struct("n", "days", "last_ts"))))
            table = table.join(of(wanted).groupBy("user_id").agg(entries.alias(f"_block{len(blocks)}")), "user_id", "left")
            blocks.append(block)
    none = F.lit(0).cast("bigint")
    made = {}
    for k, block in enumerate(blocks):
        for t in block:
            entry = F.try_element_at(F.col(f"_block{k}"), F.lit(t))
            made[t] = [
                F.coalesce(entry["n"], none).alias(f"{t}_n"),
                F.coalesce(entry["days"], none).alias(f"{t}_days"),
                (F.lit(as_of).cast("bigint") - entry["last_ts"]).alias(f"{t}_since_s"),
            ]
    return table.select("user_id", *[c for t in names for c in made[t]])
