"""Reading of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.operators.valid import valid_log
from tallyloom.session import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid rows of the behaviour log, cleaned and freed of repeats once per application and read by all reports from then on."""
    return stored(spark, "valid-log", f"{sf_dir}/user_behavior_log.parquet", lambda: valid(spark, sf_dir))


def valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid rows of the behaviour log."""
    return valid_log(table(spark, sf_dir, "user_behavior_log"))
