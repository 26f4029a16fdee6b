import random

import pytest

from tallyloom.llm.topn import band_borders, top_n


def frame(spark, data):
    return spark.createDataFrame(data, "g string, h int, item string, score bigint").selectExpr("*", "1 as _rank", "2 as rank")


@pytest.mark.parametrize("n", [0, 1, 3, 10])
def test_against_sorting(spark, n):
    r = random.Random(n)
    data = list({(g, h, i): (g, h, i, s) for g, h, i, s in ((f"g{int(r.paretovariate(0.5)) % 15}", r.randrange(2), f"i{r.randrange(400)}", int(r.paretovariate(0.8)) % 200) for _ in range(3000))}.values())
    data += [("hot", 0, f"i{k:05}", 1) for k in range(2000)] + [("few", 1, "only", 7), ("zero", 1, "z", 0), ("minus", 1, "m", -4)]
    holes = [(None, 1, "x", 5), ("a", None, "x", 5), ("a", 1, None, 5), ("a", 1, "x", None)]
    want = []
    for key in {d[:2] for d in data}:
        own = sorted((d for d in data if d[:2] == key), key=lambda d: (-d[3], d[2]))[:n]
        want += [(*d, k) for k, d in enumerate(own, 1)]
    found = top_n(frame(spark, data + holes), ["g", "h"], "item", "score", n)
    assert found.columns == ["g", "h", "item", "score", "rank"]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_edges(spark):
    assert top_n(frame(spark, []), ["g"], "item", "score", 5).count() == 0
    with pytest.raises(ValueError):
        top_n(frame(spark, []), ["g"], "item", "score", -1)
    odd = spark.createDataFrame([("g", "a", float("nan")), ("g", "b", float("inf")), ("g", "c", float("-inf")), ("g", "d", 0.25), ("g", "e", 0.5)], "g string, item string, score double")
    assert [r["item"] for r in top_n(odd, ["g"], "item", "score", 3).orderBy("rank").collect()] == ["b", "e", "d"]
    twice = top_n(frame(spark, [("g", 1, "a", 3), ("g", 1, "a", 3), ("g", 1, "b", 1)]), ["g"], "item", "score", 2)
    assert [tuple(x) for x in twice.orderBy("rank").collect()] == [("g", "a", 3, 1), ("g", "a", 3, 2)]


def test_any_scores_have_several_bands_and_filled_groups_leave_before_ranking(spark, monkeypatch):
    from tallyloom.llm import topn

    r = random.Random(5)
    data = [(f"g{k % 7}", f"i{k}", r.random() - (k % 3 == 0)) for k in range(2000)]
    df = spark.createDataFrame(data, "g string, item string, score double")
    assert len(band_borders(df, "score")) >= 5
    assert len(band_borders(df.filter("score > 0"), "score")) >= 5
    assert band_borders(df.selectExpr("1 as score"), "score") == [1.0]
    plans = []
    kept = topn.materialize
    monkeypatch.setattr(topn, "materialize", lambda d, name, *a: (plans.append((name, d._jdf.queryExecution().optimizedPlan().toString())), kept(d, name, *a))[1])
    found = top_n(df, ["g"], "item", "score", 4)
    want = [(g, i, s, k) for x in range(7) for k, (g, i, s) in enumerate(sorted((d for d in data if d[0] == f"g{x}"), key=lambda d: (-d[2], d[1]))[:4], 1)]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    lower = [p for name, p in plans if name.startswith("band-")][1:]
    assert len(lower) >= 5 and all("LeftAnti" in p and p.index("Window [") < p.index("LeftAnti") for p in lower)
