from helpers import rows

from tallyloom.operators import clean
from tallyloom.sources import behavior as sources

LINES = [
    ("U1,I1,Books,pv,1700000000", None),
    ("userId,itemId,category,behavior,timestamp", "header"),
    ("﻿userId,itemId,category,behavior,timestamp", "header"),
    ("U1,I1,Books,pv", "field_count"),
    ("U1,I1,Books,pv,1700000000,x", "field_count"),
    ("", "field_count"),
    ("U1,I1,Books,pv,", "empty_field"),
    (",I1,Books,pv,1700000000", "empty_field"),
    (" ,I1,Books,pv,1700000000", "empty_field"),
    ("U1,I1,Books,click,1700000000", "behavior"),
    ("U1,I1,Books,pv,abc", "timestamp"),
    ("U1,I1,Books,pv,0", "timestamp"),
    ("U1,I1,Books,pv,99999999999999999999", "timestamp"),
    (" U1 , I1 , Books , pv , 1700000000 ", None),
    (None, "null_line"),
    ("x" * 100_000, "field_count"),
]


def test_reasons(spark):
    df = spark.createDataFrame(LINES, "line string, expected string")
    assert [r for r in clean.parse_log_lines(df).collect() if r["reject"] != r["expected"]] == []
    assert rows(clean.clean_lines(df)) == [("U1", "I1", "Books", "pv", 1_700_000_000)] * 2
    q = clean.quality(df).first().asDict()
    assert q == {"lines": 16, "kept": 2, "null_line": 1, "header": 2, "field_count": 4, "empty_field": 3, "behavior": 1, "timestamp": 3}
    assert clean.quality(df.limit(0)).first()["lines"] == 0


def test_time_features_in_zone(spark):
    df = spark.createDataFrame([(1_700_000_000,), (None,), (1_704_119_662_000,), (-62_135_596_801,)], "ts bigint")
    found = {r["ts"]: (r["hour"], r["day_of_week"], r["is_weekend"]) for r in clean.time_features(df).collect()}
    assert found[1_700_000_000] == (6, 3, 0)
    assert found[None] == (None, None, None)
    assert found[1_704_119_662_000][0] == (1_704_119_662_000 + 28_800) % 86_400 // 3600
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert {r["ts"]: r["hour"] for r in clean.time_features(df).collect()}[1_700_000_000] == 6
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_decoders(spark):
    data = [(bytearray(b'{"userId":"U1","itemId":"I1","behavior":"pv","timestamp":1700000000}'),), (bytearray(b"\xff\xfe"),), (bytearray(b'{"other":1}'),), (bytearray(b"[1]"),), (None,)]
    found = sources.decode_messages(spark.createDataFrame(data, "value binary")).collect()
    assert len(found) == 5 and found[0]["userId"] == "U1" and found[0]["event_time"].year == 2023
    assert all(r["userId"] is None for r in found[1:])
    lines = spark.createDataFrame([("U1,I1,C,pv,17",), ("U1,I1,C,pv,x",), ("a,b",), (None,)], "line string")
    assert rows(sources.parse_lines(lines), "userId", "timestamp") == [("U1", 17)]


def test_generator_is_repeatable(spark):
    a = sources.generate(spark, 2000)
    assert rows(a) == rows(sources.generate(spark, 2000).repartition(7))
    shares = {r["behavior"]: r["count"] for r in a.groupBy("behavior").count().collect()}
    assert 800 < shares["pv"] < 1200 and set(shares) == {"pv", "cart", "fav", "buy"}


def test_report_errors(spark):
    df = spark.createDataFrame([("a", 1, 0, "2024-01-01"), ("", 1, 0, "d"), ("b", -1, 0, "d"), ("c", 1, None, "d")], "category string, total_pv bigint, total_buy bigint, report_date string")
    assert clean.report_errors(df).count() == 3


def test_node_and_edge_errors(spark):
    nodes = spark.createDataFrame([("u", 0), ("", 1), (None, 1), ("v", -1), ("w", None)], "user_id string, pv_count bigint")
    assert clean.node_errors(nodes).count() == 4
    edges = spark.createDataFrame([("a", "b", 0.0), ("", "b", 1.0), ("a", None, 1.0), ("a", "b", -0.5), ("a", "b", float("nan")), ("a", "b", None)], "src string, dst string, weight double")
    assert clean.edge_errors(edges).count() == 5
