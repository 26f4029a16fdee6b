"""Command line: make data, or run one group of reports over a CSV log.

    python -m tallyloom.cli gen PATH [ROWS]
    python -m tallyloom.cli clean|reports|stream|graph|models|tuning|all PATH [OUT]
"""

from __future__ import annotations

import argparse
import logging
import sys
from logging.handlers import TimedRotatingFileHandler
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tallyloom.operators import clean, graph, propensity, reports, tuning
from tallyloom.operators.valid import valid_log
from tallyloom.schema import Config
from tallyloom.session import build_session, release_tables, stop_session
from tallyloom.sinks.tables import attempt, write_csv, write_lines, write_parquet
from tallyloom.sources.behavior import ensure_data, generate, read_csv, read_lines, stream_source
from tallyloom.streaming.windows import run_for, sliding_windows, start_console

log = logging.getLogger("tallyloom")
MODES = ("clean", "reports", "stream", "graph", "models", "tuning", "all")


def _show(name: str, df: DataFrame, rows: int = 20) -> None:
    print(f"-- {name}")
    df.show(rows, truncate=False)


def run(spark: SparkSession, mode: str, path: str, out: str | None, config: Config) -> None:
    """Runs one group; ``all`` runs every group but the stream, which doesn't end by itself."""
    if mode == "stream":
        events = stream_source(spark, config).withColumnRenamed("userId", "user_id")
        run_for(start_console(sliding_windows(events, config.stream_window, config.stream_slide, config.stream_watermark), "update", config.stream_trigger), config.stream_timeout_s)
        return
    rows = valid_log(read_csv(spark, path))
    if mode in ("clean", "all"):
        lines = read_lines(spark, path)
        _show("quality", clean.quality(lines))
        cleaned = clean.time_features(clean.clean_lines(lines), config.feature_timezone).drop("ts")
        if out:
            write_lines(cleaned, f"{out}/cleaned")
        _show("behavior_counts", reports.behavior_counts(rows))
        _show("top_users_pv", reports.top_users(rows))
    if mode in ("reports", "all"):
        rows.printSchema()
        found = reports.funnel(spark, rows)
        _show("funnel", found)
        if out:
            result = attempt("report", lambda: write_parquet(found, f"{out}/report"))
            print(result)
        _show("hour_trend", reports.hour_trend(rows), 24)
        _show("top3_items", reports.top_items(rows), 30)
        _show("site_summary", reports.site_summary(rows))
    if mode in ("graph", "all"):
        members, class_table = graph.classes(rows)
        ranks = graph.pagerank(class_table, None, rows.select("user_id").distinct().count(), rounds=100, tolerance=0.001)
        _show("pagerank", graph.ranked_users(ranks, members, 10), 10)
        _show("components", graph.component_sizes(graph.user_components(rows)), 5)
    if mode in ("models", "all"):
        train, test = propensity.split(propensity.with_class_weight(propensity.user_features(rows)), config.ml_train_ratio)
        models = {"logistic_regression": propensity.logistic_regression(config).fit(train), "random_forest": propensity.random_forest().fit(train)}
        for name, m in models.items():
            print(name, propensity.metrics(m.transform(test)))
        if out:
            print("saved", propensity.save_best(models, test, f"{out}/model"))
    if mode in ("tuning", "all"):
        counts = reports.category_counts(rows)
        counts.explain("formatted")
        _show("category_counts", counts)
        _show("partitions", tuning.partition_sizes(rows))


class DailyLog(TimedRotatingFileHandler):
    """A log file a day; days beyond ``days``, and the oldest while all together exceed ``most_bytes``, are deleted."""

    def __init__(self, path: str, days: int = 7, most_bytes: int = 1 << 30) -> None:
        self.most_bytes = most_bytes
        super().__init__(path, when="midnight", backupCount=days, encoding="utf-8", utc=True)
        self.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s - %(message)s"))

    def doRollover(self) -> None:  # noqa: N802
        super().doRollover()
        here = Path(self.baseFilename)
        old = sorted(here.parent.glob(here.name + ".*"))
        while old and sum(f.stat().st_size for f in old) > self.most_bytes:
            old.pop(0).unlink()


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tallyloom")
    p.add_argument("mode", choices=("gen", *MODES))
    p.add_argument("path")
    p.add_argument("extra", nargs="?", help="rows for gen, else the output folder")
    p.add_argument("--log", help="file for the log, a new one each day")
    p.add_argument("--master", help="Spark master; by default the launcher's")
    a = p.parse_args(args)
    logging.basicConfig(level=logging.INFO, handlers=[logging.StreamHandler(), *([DailyLog(a.log)] if a.log else [])])
    config = Config(master=a.master)
    spark = build_session(config)
    try:
        if a.mode == "gen":
            write_csv(generate(spark, int(a.extra or 100_000)), a.path)
        else:
            if a.mode != "stream":
                ensure_data(spark, a.path)
            run(spark, a.mode, a.path, a.extra, config)
    finally:
        release_tables(spark)
        stop_session()
    return 0


if __name__ == "__main__":
    sys.exit(main())
