import random

import pytest

from tallyloom.operators.features import feature_table


def frame(spark, data):
    return spark.createDataFrame(data, "user_id string, behavior string, category string, ts bigint")


def test_against_brute_force(spark):
    r = random.Random(4)
    data = [(f"u{int(r.paretovariate(0.6)) % 12}", r.choice(["pv", "buy"]), r.choice(["a", "b c", None]), r.randrange(1, 5 * 86_400)) for _ in range(800)] + [("hot", "pv", "a", 3)] * 500 + [(None, "pv", "a", 1), ("v", None, "a", 1), ("w", "pv", "a", None)]
    got = {row["user_id"]: row.asDict() for row in feature_table(frame(spark, data), block_size=2).collect()}
    good = [d for d in data if d[0] and d[1] and d[3] is not None]
    top = max(d[3] for d in good)
    types = {"all", "pv", "buy"} | {f"{b}/{c}" for _, b, c, _ in good if c}
    assert set(got) == {d[0] for d in good}
    for u, row in got.items():
        assert len(row) == 1 + 3 * len(types)
        for t in types:
            own = [d[3] for d in good if d[0] == u and (t in ("all", d[1]) or t == f"{d[1]}/{d[2]}")]
            assert row[f"{t}_n"] == len(own)
            assert row[f"{t}_days"] == len({x // 86_400 for x in own})
            assert row[f"{t}_since_s"] == (top - max(own) if own else None)


def test_unique_by_and_as_of(spark):
    df = frame(spark, [("u", "pv", "a", 10)] * 3)
    row = feature_table(df, unique_by=df.columns, as_of=100).first()
    assert (row["all_n"], row["all_since_s"]) == (1, 90)
    assert feature_table(df, types=["buy"]).first().asDict() == {"user_id": "u", "buy_n": 0, "buy_days": 0, "buy_since_s": None}


def test_empty_and_too_many_types(spark):
    assert feature_table(frame(spark, [])).count() == 0
    from tallyloom.operators import features

    with pytest.raises(ValueError):
        features.event_types(features.type_rows(frame(spark, [("u", "pv", "a", 1), ("u", "pv", "b", 1)])), most=2)


def test_blocks_and_joins_do_not_shuffle(spark):
    df = frame(spark, [(f"u{k % 50}", "pv", f"c{k % 9}", k + 1) for k in range(900)])
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = feature_table(df, block_size=4)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 4 and "Exchange" not in plan and found.count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_like_names_are_refused(spark):
    with pytest.raises(ValueError):
        feature_table(frame(spark, [("u", "a/b", None, 1), ("u", "a", "b", 2)]))
    with pytest.raises(ValueError):
        feature_table(frame(spark, [("u", "a/b", "c", 1), ("u", "a", "b/c", 2)]))
