"""Writers of tables: Parquet, headerless text, CSV, JDBC."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.schema import Config

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class SinkResult:
    """Whether a sink took the data, and the error if not."""

    name: str
    ok: bool
    error: str = ""


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_lines(df: DataFrame, path: str) -> None:
    """Headerless comma separated text; an existing folder is replaced. Nulls are written as empty fields."""
    df.select(F.concat_ws(",", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]).alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_jdbc(df: DataFrame, config: Config, driver: str | None = None) -> None:
    """Replaces the rows of a JDBC table, keeping the table itself."""
    w = (
        df.write.format("jdbc")
        .option("url", config.jdbc_url)
        .option("dbtable", config.jdbc_table)
        .option("batchsize", config.jdbc_batch_size)
        .option("numPartitions", config.jdbc_partitions)
        .option("truncate", True)
    )
    if config.jdbc_user:
        w = w.option("user", config.jdbc_user).option("password", config.jdbc_password)
    if driver:
        w = w.option("driver", driver)
    w.mode("overwrite").save()


def attempt(name: str, action: Callable[[], None]) -> SinkResult:
    """Runs a sink whose failure mustn't end the job; the failure is logged and returned."""
    try:
        action()
    except Exception as e:  # a sink may fail in any way
        log.warning("sink %s failed: %s", name, e)
        return SinkResult(name, False, str(e))
    return SinkResult(name, True)
