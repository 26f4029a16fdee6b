import pytest
from helpers import rows
from pyspark import StorageLevel
from pyspark.ml import PipelineModel

from tallyloom.operators import graph, propensity, reports, tuning
from tallyloom.schema import Config
from tallyloom.session import shared_dir
from tallyloom.sinks import tables as sinks
from tallyloom.sources import behavior as sources
from tallyloom.streaming import windows

LOG = "user_id string, item_id string, category string, behavior string, ts bigint"


def log(spark, n=3000):
    return sources.generate(spark, n, users=60, items=200).toDF("user_id", "item_id", "category", "behavior", "ts")


def test_config_is_validated():
    Config()
    for wrong in ({"ml_train_ratio": 1.0}, {"socket_port": 0}, {"shuffle_partitions": 0}, {"jdbc_batch_size": -1}):
        with pytest.raises(ValueError):
            Config(**wrong)
    assert "secret" not in repr(Config(jdbc_password="secret"))


def test_report_invariants(spark):
    df = log(spark)
    assert sum(r["pv"] for r in reports.hour_trend(df).collect()) == df.filter("behavior = 'pv'").count()
    m = reports.category_metrics(df).collect()
    assert sum(r["market_share"] for r in m) == pytest.approx(100, abs=0.05)
    assert sum(r["total_interactions"] for r in m) == 3000
    assert [r["step_name"] for r in reports.behavior_funnel(df).collect()] == ["pv", "fav", "cart", "buy"]
    s = reports.site_summary(df).first()
    assert s["distinct_users"] == df.select("user_id").distinct().count() <= s["total_users"]


def test_reports_of_nothing(spark):
    empty = spark.createDataFrame([], LOG)
    assert reports.funnel(spark, empty).count() == reports.category_metrics(empty).count() == reports.top_items(empty).count() == reports.realtime_metrics(empty).count() == 0
    assert [r["cnt"] for r in reports.behavior_funnel(empty).collect()] == [0, 0, 0, 0]
    odd = spark.createDataFrame([(None, None, None, None, None), ("u", "i", None, "buy", 5)], LOG)
    assert reports.funnel(spark, odd).first()["conv_rate_pct"] is None
    assert reports.top_items(odd).count() == 1


def test_ties_share_a_rank(spark):
    df = spark.createDataFrame([("u", f"i{k}", "c", "buy", k) for k in range(5)], LOG)
    assert reports.top_items(df, 3).count() == 5


def test_salted_join_keeps_rows(spark):
    df = log(spark)
    dim = df.select("category").distinct().selectExpr("category", "length(category) as size")
    assert tuning.salted_join(df, dim, "category", ["user_id", "ts"]).count() == 3000
    assert rows(tuning.salted_join(df, dim, "category", ["ts"])) == rows(df.join(dim, "category").select(*df.columns, "size"))
    holes = spark.createDataFrame([(None, 1), ("x", 2)], "category string, ts bigint")
    assert tuning.salted_join(holes, dim, "category", ["ts"]).count() == 0


def test_salted_join_spreads_only_what_is_shuffled(spark):
    df = log(spark)
    dim = df.select("category").distinct().selectExpr("category", "length(category) as size")
    small = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{c}', {len(c)})" for c in sorted({r[0] for r in dim.collect()})) + " AS t(category, size)")
    plain = df.join(dim, "category").select(*df.columns, "size")
    for found, joined, salted in ((tuning.salted_join(df, small, "category", ["ts"], broadcast_bytes=1 << 40), "BroadcastHashJoin", False), (tuning.salted_join(df, small, "category", ["ts"], broadcast_bytes=-1), "SortMergeJoin", True)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert joined in plan and ("_salted" in plan) == salted
        assert rows(found) == rows(plain)


def test_lookup(spark):
    df = log(spark, 100)
    dim = spark.createDataFrame([("Books", 0.5), ("Books", None), ("Toys", 0.1), (None, 9.0), ("Food", None)], "category string, discount double")
    found = tuning.lookup(df, dim, "category", "discount")
    assert found.count() == 100
    assert {r["category"]: r["discount"] for r in found.collect()}["Books"] == 0.5
    assert {r["discount"] for r in found.filter("category <> 'Books'").collect()} == {1.0}


def test_cache_and_partitions(spark):
    df = log(spark, 500)
    for level in (StorageLevel.MEMORY_ONLY, StorageLevel.MEMORY_AND_DISK):
        assert tuning.timed_count(df, level)[0] == 500
    assert tuning.partitions(df.repartition(4)) == 4 and tuning.partitions(df.coalesce(1)) == 1
    assert sum(r["rows"] for r in tuning.partition_sizes(df.repartition(3)).collect()) == 500


def pairs_graph(spark):
    data = [("a", "i", "x", "buy", 1), ("b", "i", "x", "buy", 1), ("b", "i", "y", "buy", 1), ("c", "i", "y", "buy", 1), ("d", "i", "z", "buy", 1), ("e", "i", "z", "pv", 1), ("f", "i", "x", "buy", 1), ("g", "i", "w", "buy", 1)]
    return spark.createDataFrame(data, LOG)


def test_graph_of_classes(spark):
    df = pairs_graph(spark)
    members, table = graph.classes(df)
    assert rows(members) == [("a", "a"), ("b", "b"), ("c", "c"), ("d", "d"), ("f", "a"), ("g", "g")]
    e = graph.edges(table)
    assert rows(e, "src", "dst", "weight", "links") == [("a", "a", 1, 1), ("a", "b", 1, 2), ("b", "b", 2, 0), ("b", "c", 1, 1), ("c", "c", 1, 0), ("d", "d", 1, 0), ("g", "g", 1, 0)]
    assert rows(graph.degrees(table, e)) == [("a", 2), ("b", 3), ("c", 1)]
    assert rows(graph.user_components(df)) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "e"), ("f", "a"), ("g", "g")]
    assert rows(graph.component_sizes(graph.user_components(df)))[0] == ("a", 4)


def test_pagerank_equals_plain_iteration(spark):
    df = pairs_graph(spark)
    members, table = graph.classes(df)
    got = dict(rows(graph.ranked_users(graph.pagerank(table, graph.edges(table), 7, rounds=200, tolerance=1e-10), members)))
    links = {"a": "bf", "b": "acf", "c": "b", "f": "ab", "d": "", "g": "", "e": ""}
    r = dict.fromkeys(links, 1.0)
    for _ in range(300):
        r = {v: 0.15 + 0.85 * sum(r[u] / len(links[u]) for u in links[v]) for v in links}
    scale = 7 / sum(r.values())
    for v, x in got.items():
        assert x == pytest.approx(r[v] * scale, abs=1e-6)


def test_unknown_vertex(spark):
    ranked = spark.createDataFrame([(1, 0.5), (2, 0.1)], "vertex_id bigint, rank double")
    known = spark.createDataFrame([(1, "u1")], "vertex_id bigint, user_id string")
    assert rows(graph.with_unknown(ranked, known), "user_id") == [("Unknown",), ("u1",)]


def test_models(spark, tmp_path):
    data = propensity.with_class_weight(propensity.user_features(sources.generate(spark, 1500, users=400).toDF("user_id", "item_id", "category", "behavior", "ts")))
    train, test = propensity.split(data)
    assert train.count() + test.count() == data.count() and train.join(test, "user_id").count() == 0
    models = {"lr": propensity.logistic_regression().fit(train), "rf": propensity.random_forest(10).fit(train)}
    found = {k: propensity.metrics(m.transform(test)) for k, m in models.items()}
    assert all(0.5 < x["auc"] <= 1 for x in found.values())
    name = propensity.save_best(models, test, str(tmp_path / "model"))
    assert found[name]["auc"] == max(x["auc"] for x in found.values())
    again = PipelineModel.load(str(tmp_path / "model")).transform(test)
    assert rows(propensity.confusion(again)) == rows(propensity.confusion(models[name].transform(test)))
    clean = propensity.user_features(spark.createDataFrame([("u", "i", "c", "buy", 1), ("u", "j", "c", "pv", 1)], LOG), leak_free=True).first()
    assert (clean["item_diversity"], clean["label"]) == (1, 1.0)


def test_class_weight_of_one_class(spark):
    df = spark.createDataFrame([("u", 1.0), ("v", 1.0)], "user_id string, label double")
    assert {r["class_weight"] for r in propensity.with_class_weight(df).collect()} == {0.5}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "k string, n bigint, t string")
    sinks.write_lines(df, str(tmp_path / "lines"))
    sinks.write_lines(df, str(tmp_path / "lines"))
    assert rows(sources.read_lines(spark, str(tmp_path / "lines"))) == [("a,1,",), ("b,2,x",)]
    sinks.write_parquet(df, str(tmp_path / "p"))
    assert rows(spark.read.parquet(str(tmp_path / "p"))) == rows(df)
    config = Config(jdbc_url=f"jdbc:derby:{tmp_path}/db;create=true", jdbc_table="report", jdbc_user="", jdbc_password="")
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    done = sinks.attempt("jdbc", lambda: sinks.write_jdbc(df.select("k", "n"), config, driver))
    assert done.ok, done.error
    assert sinks.attempt("jdbc", lambda: sinks.write_jdbc(df.select("k", "n"), config, driver)).ok
    back = spark.read.format("jdbc").option("url", config.jdbc_url).option("dbtable", "report").option("driver", driver).load()
    assert rows(back) == [("a", 1), ("b", 2)]
    failed = sinks.attempt("jdbc", lambda: sinks.write_jdbc(df, Config(jdbc_url="jdbc:none:x")))
    assert not failed.ok and failed.error


def test_late_rows_are_dropped(spark, tmp_path):
    path = str(tmp_path / "in")
    batch = lambda times: spark.createDataFrame([(f"u{t}", "pv", t) for t in times], "user_id string, behavior string, ts bigint").withColumn("event_time", sources.event_time(spark_col("ts")))
    import time

    # A batch drops rows that were late by the watermark of the batch before it, so the late row comes in the third.
    for times in ([100, 110, 1000], [1005], [105, 1010]):
        batch(times).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    stream = windows.sliding_windows(sources.file_stream(spark, path, files_per_batch=1), "60 seconds", "60 seconds", watermark="10 seconds")
    found = windows.drain(spark, stream, "update", ["window", "behavior"])
    assert rows(found, "pv", "uv") == [(2, 2), (3, 3)]


def test_visitor_rows_give_exact_visitors(spark, tmp_path):
    path = str(tmp_path / "in")
    data = [("a", "pv", 5), ("a", "pv", 7), ("b", "pv", 9), (None, "pv", 10), ("b", "buy", 70), ("a", "pv", 65)]
    events = spark.createDataFrame(data, "user_id string, behavior string, ts bigint").withColumn("event_time", sources.event_time(spark_col("ts")))
    events.write.parquet(path)
    want = rows(windows.sliding_windows_batch(events), "behavior", "pv", "uv")
    for mode, keys in (("update", ["window", "behavior", "user_id"]), ("complete", None)):
        stream = windows.visitor_rows(sources.file_stream(spark, path), watermark="10 seconds" if mode == "update" else None)
        assert rows(windows.visitors(windows.drain(spark, stream, mode, keys)), "behavior", "pv", "uv") == want


def spark_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_socket_and_console(spark):
    import socket
    import threading

    server = socket.socket()
    server.bind(("127.0.0.1", 0))
    server.listen(1)

    def serve():
        c, _ = server.accept()
        c.sendall(b"U1,I1,Books,pv,1700000001\nbroken\n")
        threading.Event().wait(6)
        c.close()

    threading.Thread(target=serve, daemon=True).start()
    stream = sources.stream_source(spark, Config(socket_host="127.0.0.1", socket_port=server.getsockname()[1]), "socket")
    q = stream.writeStream.format("memory").queryName("lines").start()
    for _ in range(20):
        q.processAllAvailable()
        if spark.table("lines").count():
            break
        threading.Event().wait(0.25)
    q.stop()
    assert rows(spark.table("lines"), "userId", "timestamp") == [("U1", 1_700_000_001)]
    with pytest.raises(ValueError):
        sources.stream_source(spark, Config(), "file")
    rate = spark.readStream.format("rate").load()
    assert windows.run_for(windows.start_console(rate, "append", "1 second"), 1.5) is False


def test_explain_and_schema(spark, capsys):
    df = reports.category_counts(log(spark, 10))
    df.explain("formatted")
    df.printSchema()
    df.show(3)
    out = capsys.readouterr().out
    assert "HashAggregate" in out and "category: string" in out
    assert shared_dir(spark)
