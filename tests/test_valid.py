from helpers import rows

from tallyloom.operators.valid import normal_log, valid_log, valid_rows

SCHEMA = "userId string, itemId string, category string, behavior string, timestamp bigint, arrived_at string, user_id string"


def frame(spark, data):
    return spark.createDataFrame([(*r, "x", "clash") for r in data], SCHEMA)


def test_normal_form_and_repeats(spark):
    df = frame(
        spark,
        [
            ("U1", "I1", "Toys", "pv", 100),
            (" u1\t", "　i1", "\xa0toys", "PV\r", 100),  # the same row, spelt otherwise
            ("U1", "I1", "Garden \t\xa0Tools", "Buy", 1_700_000_000_123),
            ("U1", "I1", "garden tools", "buy", 1_700_000_000),
        ],
    )
    assert rows(valid_log(df)) == [("U1", "I1", "garden tools", "buy", 1_700_000_000), ("U1", "I1", "toys", "pv", 100)]
    assert valid_rows(df).count() == 4


def test_what_is_invalid(spark):
    bad = [
        (None, "I1", "a", "pv", 1),
        ("U1", None, "a", "pv", 1),
        ("U1", "I1", None, "pv", 1),
        ("U1", "I1", " \xa0", "pv", 1),
        ("U1", "I1", "a", "click", 1),
        ("U1", "I1", "a", None, 1),
        ("U1", "I1", "a", "pv", 0),
        ("U1", "I1", "a", "pv", -5),
        ("U1", "I1", "a", "pv", None),
        ("U", "I1", "a", "pv", 1),
        ("U-1", "I1", "a", "pv", 1),
        ("U1 2", "I1", "a", "pv", 1),
        ("U١", "I1", "a", "pv", 1),  # digits of another script
        ("U1", "I12x", "a", "pv", 1),
        ("U1", "I1", "a", "p v", 1),
    ]
    assert valid_log(frame(spark, bad)).count() == 0
    assert normal_log(frame(spark, bad)).count() == len(bad)


def test_edges_of_milliseconds(spark):
    df = frame(spark, [("U1", "I1", "a", "pv", 99_999_999_999), ("U2", "I1", "a", "pv", 100_000_000_000)])
    assert rows(valid_log(df), "user_id", "ts") == [("U1", 99_999_999_999), ("U2", 100_000_000)]


def test_empty(spark):
    assert valid_log(frame(spark, [])).count() == 0
