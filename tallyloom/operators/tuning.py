"""Physical operators: lookups, salted joins, caching, partitioning."""

from __future__ import annotations

import time

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.schema import DISCOUNTS

#: Largest table that is broadcast, in bytes as the optimiser estimates it.
BROADCAST_BYTES = 10 * 1024 * 1024


def plan_bytes(df: DataFrame) -> int:
    """Size of a frame as the optimiser estimates it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def lookup(facts: DataFrame, dim: DataFrame, key: str, value: str, default: float = 1.0) -> DataFrame:
    """facts with a value of dim, default where dim has none or null. dim is broadcast if its estimated size is within BROADCAST_BYTES, else joined by shuffle."""
    small = dim.select(key, value).groupBy(key).agg(F.max(value).alias(value))
    side = F.broadcast(small) if plan_bytes(dim) <= BROADCAST_BYTES else small
    return facts.join(side, key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def lookup_map(facts: DataFrame, key: str = "category", values: dict[str, float] | None = None, default: float = 1.0) -> DataFrame:
    """facts with discount from a literal map, without a join."""
    pairs = [F.lit(x) for kv in (values or DISCOUNTS).items() for x in kv]
    return facts.withColumn("discount", F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(key)), F.lit(default)))


def explode_salt(dim: DataFrame, salts: int) -> DataFrame:
    """Every row once for each salt 0 to salts - 1."""
    return dim.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def salted_join(facts: DataFrame, dim: DataFrame, key: str, spread_by: list[str], salts: int = 10, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Inner join in which a hot key of facts is spread over ``salts`` partitions; dim is repeated so often. A dim whose estimated size is within broadcast_bytes is broadcast instead, as
    then nothing is shuffled and there is nothing to spread.

    The salt is a hash of spread_by, the same in every run and after a lost executor. Columns of dim other than key must not clash with those of facts; rows with
    a null key drop out.
    """
    if plan_bytes(dim) <= broadcast_bytes:
        return facts.join(F.broadcast(dim), key).select(*facts.columns, *[c for c in dim.columns if c != key])
    salted = facts.withColumn("_salted", F.concat_ws("_", F.col(key), F.pmod(F.xxhash64(*spread_by), F.lit(salts)))).filter(F.col(key).isNotNull())
    spread = explode_salt(dim.filter(F.col(key).isNotNull()), salts).withColumn("_salted", F.concat_ws("_", F.col(key), F.col("salt"))).drop(key, "salt")
    return salted.join(spread.hint("merge"), "_salted").drop("_salted")


def timed_count(df: DataFrame, level: StorageLevel) -> tuple[int, float]:
    """Rows of a frame cached at a level, and seconds of a count that reads the cache; the cache is released."""
    df.persist(level)
    try:
        df.count()
        began = time.perf_counter()
        n = df.count()
        return n, time.perf_counter() - began
    finally:
        df.unpersist()


def partitions(df: DataFrame) -> int:
    return df.rdd.getNumPartitions()


def partition_sizes(df: DataFrame) -> DataFrame:
    """partition and rows of each non-empty partition."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count(F.lit(1)).alias("rows"))
