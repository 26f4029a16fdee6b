import random
from collections import Counter
from itertools import combinations

import pytest

from tallyloom.llm.pairs import PairStore


def frame(spark, data):
    return spark.createDataFrame(data, "period string, basket string, item string, op int").selectExpr("*", "'x' as n", "1 as bucket")


def brute(members, least, lift):
    baskets = {}
    for p, b, i in members:
        baskets.setdefault((p, b), set()).add(i)
    total, single, both = Counter(), Counter(), Counter()
    for (p, _), items in baskets.items():
        total[p] += 1
        single.update((p, i) for i in items)
        both.update((p, *ab) for ab in combinations(sorted(items), 2))
    out = []
    for (p, a, b), n in both.items():
        na, nb = single[p, a], single[p, b]
        if n >= least and n * total[p] >= lift * na * nb:
            out.append((p, a, b, total[p], na, nb, n))
    return sorted(out)


def scored(store, *a):
    return sorted(tuple(r)[:7] for r in store.scores(None, *a).collect())


@pytest.mark.parametrize("heavy", [3, 12, 1000])
def test_heavy_and_light_baskets_give_the_same(spark, heavy):
    r = random.Random(heavy)
    members = {(f"p{r.randrange(2)}", f"b{r.randrange(60)}", f"i{int(r.paretovariate(0.6)) % 50}") for _ in range(900)}
    for k in range(7):  # one basket's owner takes a third of all rows
        members |= {("p0", f"hot{k}", f"i{r.randrange(80)}") for _ in range(60)}
    store = PairStore(spark, heavy=heavy, buckets=3)
    store.apply(frame(spark, [(*m, 1) for m in members]))
    for least, lift in ((1, 0), (2, 1), (5, 2), (5, 10)):
        assert scored(store, least, lift) == brute(members, least, lift), (least, lift)


def test_increments_and_removals(spark):
    r = random.Random(3)
    store = PairStore(spark, heavy=6, buckets=4)
    now = set()
    for step in range(4):
        add = {(f"p{r.randrange(3)}", f"b{r.randrange(12)}", f"i{r.randrange(15)}") for _ in range(90)}
        gone = set(r.sample(sorted(now), len(now) // 3)) - add
        changed = store.apply(frame(spark, [(*m, 1) for m in add] + [(*m, -1) for m in gone]))
        before, now = now, (now | add) - gone
        assert {p for p, *_ in before ^ now} <= set(changed)
        assert scored(store, 1, 0) == brute(now, 1, 0), step
    store.apply(frame(spark, [(*m, -1) for m in now]))
    assert scored(store, 1, 0) == []


def test_edges(spark):
    store = PairStore(spark)
    assert store.apply(frame(spark, [])) == [] and store.scores().count() == 0
    data = [("p", "b", "x", 1), ("p", "b", "x", 1), ("p", "b", "y", 1), ("p", "b", "y", -1), (None, "b", "z", 1), ("p", None, "z", 1), ("p", "b", None, 1), ("p", "c", "gone", -1)]
    store.apply(frame(spark, data))
    assert store.scores().count() == 0
    assert sorted(tuple(r)[:2] for r in store.table("items").collect()) == [("x", 1)]
    with pytest.raises(ValueError):
        store.scores(min_count=0)
    with pytest.raises(ValueError):
        PairStore(spark, buckets=0)


def test_a_store_is_opened_again(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    first = {("p", f"b{k % 9}", f"i{k % 7}") for k in range(60)}
    PairStore(spark, path, buckets=2, heavy=3).apply(frame(spark, [(*m, 1) for m in first]))
    other = PairStore(spark, path)
    assert (other.buckets, other.heavy) == (2, 3) and scored(other, 1, 0) == brute(first, 1, 0)
    more, gone = {("p", "b1", "i9"), ("q", "b1", "i2"), ("q", "b1", "i3")}, {("p", "b2", "i2")}
    reader = PairStore(spark, path)
    assert other.apply(frame(spark, [(*m, 1) for m in more] + [(*m, -1) for m in gone])) != []
    assert scored(reader, 1, 0) == brute(first, 1, 0)  # an older version stays readable
    reader.refresh()
    now = (first | more) - gone
    assert scored(reader, 1, 0) == scored(other, 1, 0) == brute(now, 1, 0)
    other.vacuum()
    assert scored(PairStore(spark, path), 1, 0) == brute(now, 1, 0)


def test_a_second_writer_and_a_failed_batch_do_no_harm(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/store"
    first = {("p", "b1", "i1"), ("p", "b1", "i2")}
    store = PairStore(spark, path)
    store.apply(frame(spark, [(*m, 1) for m in first]))
    late = PairStore(spark, path)
    store.apply(frame(spark, [("p", "b2", "i1", 1)]))
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(late, "refresh", lambda: None)  # it began before the other's batch was there
        late.apply(frame(spark, [("p", "b3", "i1", 1)]))
    now = first | {("p", "b2", "i1")}
    assert scored(PairStore(spark, path), 1, 0) == brute(now, 1, 0)
    late.refresh()
    late.apply(frame(spark, [("p", "b3", "i1", 1)]))
    assert scored(late, 1, 0) == brute(now | {("p", "b3", "i1")}, 1, 0)
