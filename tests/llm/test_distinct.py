import random

import pytest

from tallyloom.llm import distinct


def frame(spark, data):
    return spark.createDataFrame(data, "day string, kind string, user string").selectExpr("*", "'x' as word_no")


def test_estimates_stay_within_the_bound(spark):
    r = random.Random(1)
    data = [(f"d{i % 3}", r.choice(["a", "b", None]), f"u{int(r.paretovariate(0.4)) % 40_000}") for i in range(60_000)] + [("d0", "a", None)] * 5
    bits = distinct.bitmap_bits(50_000, 0.03)
    stored = distinct.bitmaps(frame(spark, data), ["day", "kind"], "user", bits).persist()
    for row in distinct.cube_estimates(stored, ["day", "kind"], bits).collect():
        kept = row["level"].split("+") if row["level"] else []
        true = len({u for d, k, u in data if u and ("day" not in kept or d == row["day"]) and ("kind" not in kept or k == row["kind"])})
        assert abs(row["estimate"] - true) <= max(row["error_bound"], 1) and row["error_bound"] <= 0.03 * max(true, 40)


def test_merge_equals_all_at_once_and_repeats_do_no_harm(spark):
    data = [(f"d{i % 4}", "a", f"u{i % 700}") for i in range(3000)]
    df = frame(spark, data)
    one = distinct.bitmaps(df, [], "user", 4096)
    parts = distinct.bitmaps(df, ["day"], "user", 4096)
    merged = distinct.merge(parts.unionByName(parts), [])
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, merged.collect()))


def test_sizes_and_edges(spark):
    assert distinct.bitmap_bits(10, 0.5) == 64
    assert distinct.relative_error(10**6, distinct.bitmap_bits(10**6, 0.01)) * 3 <= 0.01
    for wrong in ((0, 0.1), (5, 0), (5, 1)):
        with pytest.raises(ValueError):
            distinct.bitmap_bits(*wrong)
    with pytest.raises(ValueError):
        distinct.bitmaps(frame(spark, []), [], "user", 100)
    assert distinct.cube_estimates(distinct.bitmaps(frame(spark, []), ["day"], "user", 64), ["day"], 64).count() == 0
    full = distinct.bitmaps(frame(spark, [("d", "a", f"u{i}") for i in range(3000)]), ["day"], "user", 64)
    row = distinct.estimate(full, ["day"], 64).first()
    assert row["bits_set"] == 64 and row["estimate"] is None and row["error_bound"] is None


def test_size_follows_the_rows(spark):
    """Sized for a hundredth of the identifiers that come, a bitmap is full and tells nothing; sized from the rows it is within its bound."""
    many = spark.range(300_000).selectExpr("concat('u', id) as user", "concat('d', id % 3) as day")
    small = distinct.bitmap_bits(3000, 0.05)
    assert distinct.estimate(distinct.bitmaps(many, [], "user", small), [], small).first()["estimate"] is None
    bits = distinct.sized_bits(many, "user", 0.05, 5.0)
    for row in distinct.cube_estimates(distinct.bitmaps(many, ["day"], "user", bits), ["day"], bits, 5.0).collect():
        true = 100_000 if row["day"] else 300_000
        assert abs(row["estimate"] - true) <= row["error_bound"] <= 0.05 * true
    assert distinct.bitmap_bits(40_000_000, 0.01) > distinct.bitmap_bits(10_000_000, 0.01)
    assert distinct.sized_bits(many.limit(0), "user", 0.05) >= 64
