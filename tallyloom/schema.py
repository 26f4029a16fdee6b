"""Record schemas, fixed values and the validated configuration."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import types as T

#: The behaviours of the log, in funnel order.
BEHAVIORS = ("pv", "fav", "cart", "buy")
#: Categories of the synthetic generator, and the draw weights of its behaviours.
GENERATOR_CATEGORIES = ("Electronics", "Clothing", "Food", "Books", "Sports", "Beauty")
GENERATOR_BEHAVIORS = ("pv", "pv", "pv", "cart", "fav", "buy")
#: Discount by category; any other category has 1.0.
DISCOUNTS = {"Electronics": 0.9, "Clothing": 0.8, "Food": 0.95, "Books": 0.85, "Sports": 0.88, "Beauty": 0.75}
#: Categories of the broadcast filter.
FOCUS_CATEGORIES = ("Electronics", "Clothing", "Food")

LOG_SCHEMA = T.StructType(
    [
        T.StructField("userId", T.StringType()),
        T.StructField("itemId", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("behavior", T.StringType()),
        T.StructField("timestamp", T.LongType()),
    ]
)
#: Kafka messages have no category.
MESSAGE_DDL = "userId STRING, itemId STRING, behavior STRING, timestamp LONG"


@dataclass(frozen=True)
class Config:
    """Settings of the engine; constructing one validates it.

    Credentials of the JDBC sink come from the environment only and have no default.
    """

    app_name: str = "tallyloom"
    #: None leaves it to the launcher, which runs locally unless told otherwise.
    master: str | None = None
    feature_timezone: str = "Asia/Shanghai"
    data_dir: str = "data"
    output_dir: str = "output"
    jdbc_url: str = "jdbc:mysql://localhost:3306/retail"
    jdbc_table: str = "sales_report"
    jdbc_user: str = field(default_factory=lambda: os.environ.get("JDBC_USER", ""))
    jdbc_password: str = field(default_factory=lambda: os.environ.get("JDBC_PASSWORD", ""), repr=False)
    jdbc_batch_size: int = 1000
    jdbc_partitions: int = 4
    kafka_servers: str = "localhost:9092"
    kafka_topic: str = "user_behavior"
    stream_window: str = "60 seconds"
    stream_slide: str = "30 seconds"
    stream_watermark: str = "10 seconds"
    stream_trigger: str = "10 seconds"
    stream_timeout_s: float = 60.0
    socket_host: str = "localhost"
    socket_port: int = 9999
    ml_train_ratio: float = 0.8
    ml_max_iter: int = 100
    ml_reg_param: float = 0.01
    shuffle_partitions: int = 200
    default_parallelism: int = 4
    executor_memory: str = "2g"
    driver_memory: str = "1g"
    broadcast_bytes: int = 10 * 1024 * 1024

    def __post_init__(self) -> None:
        checks = {
            "app_name must not be empty": bool(self.app_name),
            "master must not be empty": self.master is None or bool(self.master),
            "data_dir must not be empty": bool(self.data_dir),
            "jdbc_batch_size must be positive": self.jdbc_batch_size > 0,
            "jdbc_partitions must be positive": self.jdbc_partitions > 0,
            "stream_timeout_s must be positive": self.stream_timeout_s > 0,
            "socket_port must be 1 to 65535": 0 < self.socket_port < 65_536,
            "ml_train_ratio must lie between 0 and 1": 0 < self.ml_train_ratio < 1,
            "ml_max_iter must be positive": self.ml_max_iter > 0,
            "ml_reg_param must not be negative": self.ml_reg_param >= 0,
            "shuffle_partitions must be positive": self.shuffle_partitions > 0,
            "default_parallelism must be positive": self.default_parallelism > 0,
        }
        wrong = [text for text, holds in checks.items() if not holds]
        if wrong:
            raise ValueError("; ".join(wrong))
