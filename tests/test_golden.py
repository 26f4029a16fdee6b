"""Reports over the log that the generator's specification gives for seed 42, against numbers worked out independently."""

import pytest
from helpers import rows

from tallyloom.operators import clean, graph, propensity, reports
from tallyloom.schema import GENERATOR_BEHAVIORS, GENERATOR_CATEGORIES


class Random48:
    """The 48-bit linear congruential generator of the Java library."""

    def __init__(self, seed):
        self.state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)

    def below(self, n):
        while True:
            self.state = (self.state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
            bits = self.state >> 17
            if n & (n - 1) == 0:
                return n * bits >> 31
            if bits - bits % n + n - 1 < 1 << 31:
                return bits % n


@pytest.fixture(scope="module")
def log(spark):
    r = Random48(42)
    data = [
        (f"U{r.below(5000) + 1}", f"I{r.below(20_000) + 1}", GENERATOR_CATEGORIES[r.below(6)], GENERATOR_BEHAVIORS[r.below(6)], 1_700_000_000 + r.below(604_800))
        for _ in range(100_000)
    ]
    assert data[0] == ("U1131", "I12764", "Electronics", "pv", 1_700_109_170)
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame(data, columns=["user_id", "item_id", "category", "behavior", "ts"])).persist()


def test_counts(log):
    assert dict(rows(reports.behavior_counts(log))) == {"pv": 49_894, "fav": 16_854, "buy": 16_702, "cart": 16_550}
    assert log.select("user_id").distinct().count() == 5000 and log.select("item_id").distinct().count() == 19_878
    assert clean.filter_categories(log, ("Electronics", "Clothing", "Food")).count() == 50_121


def test_funnel(spark, log):
    assert {r[0]: r[1:] for r in rows(reports.funnel(spark, log))} == {
        "Food": (8130, 2832, 2889, 35.54), "Clothing": (8377, 2711, 2819, 33.65), "Electronics": (8337, 2737, 2803, 33.62),
        "Sports": (8273, 2848, 2783, 33.64), "Beauty": (8311, 2709, 2724, 32.78), "Books": (8466, 2713, 2684, 31.70),
    }


def test_hours_weekdays_and_tops(log):
    hours = rows(reports.hour_trend(log))
    assert hours[0] == (0, 2055, 1689) and hours[13] == (13, 1950, 1610) and hours[23] == (23, 1914, 1595)
    days = clean.time_features(log).groupBy("day_of_week").count()
    assert rows(days) == [(1, 14_334), (2, 14_310), (3, 14_086), (4, 14_456), (5, 14_001), (6, 14_479), (7, 14_334)]
    assert reports.top_items(log).count() == 45
    assert [tuple(r) for r in reports.top_users(log).collect()][:3] == [("U343", 25), ("U4804", 24), ("U4021", 22)]


def test_features_and_graph(log):
    f = propensity.user_features(log)
    assert dict(rows(f.groupBy("label").count())) == {0.0: 196, 1.0: 4804}
    assert f.selectExpr("sum(item_diversity)").first()[0] == 99_955
    weights = dict(rows(propensity.with_class_weight(f).selectExpr("label", "round(class_weight, 4)").distinct()))
    assert weights == {0.0: 12.7551, 1.0: 0.5204}
    sizes = graph.component_sizes(graph.user_components(log)).collect()
    assert len(sizes) == 197 and sizes[0]["size"] == 4804
    links = graph.edges(graph.classes(log)[1])
    assert links.selectExpr("sum(links)").first()[0] == 8_668_587
    assert dict(rows(links.groupBy("weight").agg({"links": "sum"}).filter("weight < 6")))[1] == 4_935_358
