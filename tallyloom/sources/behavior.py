"""Readers and decoders of behaviour logs: CSV files, raw lines, Kafka messages, socket lines, and a seeded generator."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.schema import GENERATOR_BEHAVIORS, GENERATOR_CATEGORIES, LOG_SCHEMA, MESSAGE_DDL, Config

log = logging.getLogger(__name__)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header under the fixed schema: no pass over the data to infer one. Malformed rows become nulls."""
    return spark.read.schema(LOG_SCHEMA).option("header", True).option("mode", "PERMISSIVE").csv(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines (line) of text files."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def kafka_stream(spark: SparkSession, config: Config) -> DataFrame:
    """One topic as a stream from its latest offset. The connector package must be on the class path; decode_messages takes any frame with a binary ``value``."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", config.kafka_servers)
        .option("subscribe", config.kafka_topic)
        .option("startingOffsets", "latest")
        .option("failOnDataLoss", "false")
        .load()
    )


def socket_stream(spark: SparkSession, config: Config) -> DataFrame:
    """Lines (value) from a socket."""
    return spark.readStream.format("socket").option("host", config.socket_host).option("port", config.socket_port).load()


def stream_source(spark: SparkSession, config: Config, source: str = "socket") -> DataFrame:
    """Decoded events of the chosen stream source."""
    if source == "kafka":
        return decode_messages(kafka_stream(spark, config))
    if source == "socket":
        return parse_lines(socket_stream(spark, config), "value")
    raise ValueError("source must be kafka or socket")


def file_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet file or folder as a stream."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    r = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    if fs.getFileStatus(fs_path).isFile():
        folder, name = path.rsplit("/", 1)
        return r.option("pathGlobFilter", name).parquet(folder)
    return r.parquet(path)


def event_time(ts: Column) -> Column:
    """TIMESTAMP of epoch seconds."""
    return F.timestamp_seconds(ts)


def decode_messages(messages: DataFrame, value: str = "value") -> DataFrame:
    """userId, itemId, behavior, timestamp, event_time of JSON messages in a binary or string column.

    Broken or foreign JSON, and fields of other types, give nulls; nothing fails. Works on a stream or a table.
    """
    text = F.col(value).cast("string")
    return messages.select(F.from_json(text, MESSAGE_DDL, {"mode": "PERMISSIVE"}).alias("data")).select("data.*").withColumn("event_time", event_time(F.col("timestamp")))


def parse_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """userId, itemId, category, behavior, timestamp, event_time of comma separated lines with exactly five fields; a bad number leaves the line out."""
    f = F.split(F.col(line), ",")
    ts = f[4].try_cast("bigint")
    return (
        lines.filter(F.size(f) == 5)
        .select(f[0].alias("userId"), f[1].alias("itemId"), f[2].alias("category"), f[3].alias("behavior"), ts.alias("timestamp"))
        .filter("timestamp is not null")
        .withColumn("event_time", event_time(F.col("timestamp")))
    )


#: First second, users, items and days of the generator.
GENERATOR_START, GENERATOR_USERS, GENERATOR_ITEMS, GENERATOR_DAYS = 1_700_000_000, 5000, 20_000, 7


def generate(spark: SparkSession, rows: int = 100_000, seed: int = 42, start: int = GENERATOR_START, users: int = GENERATOR_USERS, items: int = GENERATOR_ITEMS, days: int = GENERATOR_DAYS) -> DataFrame:
    """A synthetic log, the same for the same arguments: every value is a hash of seed, row and column, so partitioning doesn't matter."""
    draw = lambda k, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col("id")), F.lit(n).cast("bigint"))
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))
    return spark.range(rows).select(
        F.concat(F.lit("U"), draw(1, users) + 1).alias("userId"),
        F.concat(F.lit("I"), draw(2, items) + 1).alias("itemId"),
        pick(GENERATOR_CATEGORIES, draw(3, len(GENERATOR_CATEGORIES))).alias("category"),
        pick(GENERATOR_BEHAVIORS, draw(4, len(GENERATOR_BEHAVIORS))).alias("behavior"),
        (F.lit(start) + draw(5, days * 86_400)).cast("bigint").alias("timestamp"),
    )


def ensure_data(spark: SparkSession, path: str, rows: int = 100_000) -> str:
    """Writes a generated log as CSV unless something is at the path already; returns the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        log.info("generating %d rows at %s", rows, path)
        generate(spark, rows).write.option("header", True).csv(path)
    return path
