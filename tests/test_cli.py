import pytest
from helpers import rows

from tallyloom import cli, session
from tallyloom.schema import Config
from tallyloom.session import materialize, release_tables
from tallyloom.sources.behavior import ensure_data


def test_every_group_runs(spark, tmp_path, capsys):
    path = ensure_data(spark, str(tmp_path / "log"), rows=1500)
    before = rows(spark.read.text(path))
    assert ensure_data(spark, path, rows=10) == path and rows(spark.read.text(path)) == before  # what is there stays
    cli.run(spark, "all", path, str(tmp_path / "out"), Config())
    out = capsys.readouterr().out
    assert all(f"-- {x}" in out for x in ("quality", "funnel", "hour_trend", "pagerank", "components", "partitions")) and "saved" in out
    assert spark.read.parquet(str(tmp_path / "out/report")).count() == 6
    assert spark.read.text(str(tmp_path / "out/cleaned")).count() == 1500


def test_modes_are_strict():
    with pytest.raises(SystemExit):
        cli.main(["everything", "x"])


def test_tables_are_released(spark):
    t = materialize(spark.range(10), "some")
    assert t.count() == 10
    release_tables(spark)
    with pytest.raises(Exception):
        spark.read.parquet(t.inputFiles()[0]).count()


def test_cluster_needs_a_shared_folder(spark):
    class Elsewhere:
        conf = {}
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        session.shared_dir(Elsewhere())
    Elsewhere.conf = {"spark.checkpoint.dir": "hdfs://host/shared/"}
    assert session.shared_dir(Elsewhere()) == "hdfs://host/shared"


def test_scan_gets_filters_and_few_columns(spark, tmp_path):
    from tallyloom.operators.reports import funnel, top_items
    from tallyloom.operators.valid import valid_rows
    from tallyloom.sources.behavior import generate

    generate(spark, 100).write.parquet(str(tmp_path / "p"))
    log = valid_rows(spark.read.parquet(str(tmp_path / "p")))
    plan = funnel(spark, log)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(timestamp)" in plan and "GreaterThan(timestamp,0)" in plan
    assert "WindowGroupLimit" in top_items(log)._jdf.queryExecution().toString()


def test_stored_tables_follow_their_source(spark, tmp_path):
    made = []
    path = str(tmp_path / "in")

    def get():
        return session.stored(spark, "some", path, lambda: (made.append(1), spark.read.parquet(path))[1]).count()

    spark.range(3).write.parquet(path)
    assert (get(), get(), len(made)) == (3, 3, 1)
    release_tables(spark, keep_stored=True)
    assert (get(), len(made)) == (3, 1)
    spark.range(2).write.mode("append").parquet(path)
    assert (get(), len(made)) == (5, 2)
    release_tables(spark)
    assert (get(), len(made)) == (5, 3)


def test_daily_log(tmp_path):
    h = cli.DailyLog(str(tmp_path / "app.log"), days=7, most_bytes=250)
    for day in range(5):
        (tmp_path / f"app.log.2020-01-0{day + 1}").write_text("x" * 100)
    h.doRollover()
    h.close()
    kept = sorted(p.name for p in tmp_path.iterdir())
    assert sum(p.stat().st_size for p in tmp_path.iterdir()) <= 250 and "app.log.2020-01-05" in kept and "app.log.2020-01-01" not in kept


def test_no_master_is_forced(monkeypatch):
    seen = {}

    class Builder:
        def appName(self, x):  # noqa: N802
            return self

        def master(self, x):
            seen["master"] = x
            return self

        def config(self, k, v):
            seen[k] = v
            return self

        def getOrCreate(self):  # noqa: N802
            return seen

    monkeypatch.setattr(session, "SparkSession", type("S", (), {"builder": Builder()}))
    monkeypatch.setenv("PYSPARK_GATEWAY_PORT", "1")
    assert "master" not in session.build_session() and "spark.executor.memory" not in seen
    monkeypatch.delenv("PYSPARK_GATEWAY_PORT")
    assert session.build_session(Config(master="local[2]"))["master"] == "local[2]" and seen["spark.executor.memory"]
