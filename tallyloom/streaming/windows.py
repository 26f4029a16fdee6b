"""Windowed views and visitors on Structured Streaming, and the batch form of the same."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallyloom.session import new_path

log = logging.getLogger(__name__)


def sliding_windows(events: DataFrame, width: str = "60 seconds", slide: str = "30 seconds", watermark: str | None = None, approximate: bool = False) -> DataFrame:
    """window, behavior, pv and uv of events (event_time TIMESTAMP, behavior, user_id), on a stream or a table.

    Streams can't count distinct values incrementally, so uv is the size of the set of users, exact, which is one row of state: for windows with very many users take ``approximate``,
    a sketch of fixed size, or visitor_rows, which are exact and keep rows instead. A watermark closes windows and drops later rows; without one a stream keeps every window.
    """
    if watermark:
        events = events.withWatermark("event_time", watermark)
    uv = F.approx_count_distinct("user_id") if approximate else F.size(F.collect_set("user_id"))
    return events.groupBy(F.window("event_time", width, slide), "behavior").agg(F.count(F.lit(1)).alias("pv"), uv.cast("bigint").alias("uv"))


def sliding_windows_batch(events: DataFrame, width: str = "60 seconds", slide: str = "30 seconds") -> DataFrame:
    """The same of a table, with a distinct count that combines on the map side."""
    return events.groupBy(F.window("event_time", width, slide), "behavior").agg(F.count(F.lit(1)).alias("pv"), F.countDistinct("user_id").alias("uv"))


def visitor_rows(events: DataFrame, width: str = "60 seconds", slide: str = "30 seconds", watermark: str | None = None) -> DataFrame:
    """window, behavior, user_id and views of each visitor, on a stream or a table: what exact visitor counts of any number of users need. A row of state for each, spread by all of
    its keys, so no window's users are ever in one row or task."""
    if watermark:
        events = events.withWatermark("event_time", watermark)
    return events.groupBy(F.window("event_time", width, slide), "behavior", "user_id").agg(F.count(F.lit(1)).alias("views"))


def visitors(rows: DataFrame) -> DataFrame:
    """window, behavior, pv and uv of visitor_rows, the last of each key."""
    return rows.groupBy("window", "behavior").agg(F.sum("views").alias("pv"), F.count("user_id").alias("uv"))


def start_console(df: DataFrame, mode: str, trigger: str = "10 seconds", checkpoint: str | None = None, rows: int = 20) -> StreamingQuery:
    """Prints each batch. The checkpoint belongs to the writer."""
    w = df.writeStream.outputMode(mode).format("console").option("truncate", False).option("numRows", rows).trigger(processingTime=trigger)
    return (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()


def run_for(query: StreamingQuery, seconds: float) -> bool:
    """Lets a query run for so long and stops it; whether it ended by itself."""
    ended = query.awaitTermination(seconds)
    query.stop()
    return bool(ended)


def drain(spark: SparkSession, df: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over all that its source has now, and returns the result table.

    Batches go to a table in the shared folder, not to the driver. In update mode each batch appends the rows it changed and the last of each key counts; in
    complete mode the last batch is the result; in append mode all rows are.
    """
    out = new_path(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/{'all' if mode == 'complete' else number}")

    q = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", new_path(spark, "stream-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    found = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_batch", T.IntegerType())])).option("recursiveFileLookup", True).parquet(out)
    if mode == "update" and keys:
        rest = [c for c in df.columns if c not in keys]
        found = found.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_row")).select(*keys, "_row.*")
    return found.drop("_batch")


def each_batch(df: DataFrame, action: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Starts a stream that hands each batch to an action."""
    return df.writeStream.foreachBatch(action).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
