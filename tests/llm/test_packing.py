import random
from collections import defaultdict

import numpy as np
import pytest

from tallyloom.llm.packing import best_configuration, fullest, pack, plan_containers, solve, token_sizes


def check(found, sizes, capacity):
    """Every item whole and once, nothing over the capacity, places without gap or overlap; the number of containers in use."""
    by, seen = defaultdict(list), defaultdict(list)
    for r in found:
        by[r["container_id"]].append((r["place"], r["start_offset"], r["n_tokens"]))
        seen[r["doc_id"]].append((r["piece"], r["n_tokens"]))
    for d, n in sizes.items():
        pieces = sorted(seen[d])
        assert [p for p, _ in pieces] == list(range(len(pieces)))
        assert sum(k for _, k in pieces) == max(n or 0, 0)
        assert all(k == capacity for _, k in pieces[:-1]) and len(pieces) == max(1, -(-max(n or 0, 0) // capacity))
    for items in by.values():
        items.sort()
        assert sum(k for *_, k in items) <= capacity
        assert [p for p, *_ in items] == list(range(len(items)))
        at = 0
        for _, offset, k in items:
            assert offset == (at if k else 0)
            at += k
    assert set(seen) == set(sizes)
    return len(by)


@pytest.mark.parametrize("capacity", [1, 10, 64, 500])
def test_packs_close_to_the_bound(spark, capacity):
    r = random.Random(capacity)
    sizes = {i: min(int(r.paretovariate(0.9) * 3), 1500) for i in range(1500)} | {i: 7 for i in range(2000, 2700)} | {i: 0 for i in range(3000, 3300)} | {4000: None, 4001: -3}
    df = spark.createDataFrame(list(sizes.items()), "doc_id bigint, n_tokens bigint").selectExpr("*", "1 as piece", "2 as place")
    found = pack(df, capacity).collect()
    used = check(found, sizes, capacity)
    total = sum(max(n or 0, 0) for n in sizes.values())
    if capacity >= 64:
        assert used <= 1.01 * total / capacity + 1
    assert sorted(map(tuple, found)) == sorted(map(tuple, pack(df.repartition(7), capacity).collect()))


def test_edges(spark):
    df = lambda d: spark.createDataFrame(d, "doc_id bigint, n_tokens bigint")
    assert pack(df([]), 10).count() == 0
    assert check(pack(df([(1, 0), (2, 0)]), 10).collect(), {1: 0, 2: 0}, 10) == 1
    assert check(pack(df([(1, 35)]), 10).collect(), {1: 35}, 10) == 4
    with pytest.raises(ValueError):
        pack(df([]), 0)


def test_plan_holds_the_histogram_whatever_its_scale():
    r = random.Random(2)
    small = {s: r.randrange(1, 9) for s in r.sample(range(1, 100), 70)}
    for scale in (1, 10**9):
        hist = {s: n * scale for s, n in small.items()}
        plan = plan_containers(hist, 200)
        held = defaultdict(int)
        for config, copies in plan:
            assert sum(s * k for s, k in config.items()) <= 200 and copies > 0
            for s, k in config.items():
                held[s] += k * copies
        assert dict(held) == hist
        assert sum(c for _, c in plan) <= 1.02 * sum(s * n for s, n in hist.items()) / 200 + 1
    with pytest.raises(ValueError):
        plan_containers({11: 1}, 10)


def test_knapsack_against_enumeration():
    import numpy as np
    from itertools import product

    r = random.Random(5)
    for _ in range(40):
        sizes = np.array(sorted(r.sample(range(1, 12), 4)))
        prices = np.array([r.random() for _ in range(4)])
        most = np.array([r.randrange(0, 4) for _ in range(4)])
        best = max(float(np.dot(k, prices)) for k in product(*[range(m + 1) for m in most]) if np.dot(k, sizes) <= 20)
        got = best_configuration(sizes, prices, most, 20)
        assert sum(sizes[i] * k for i, k in got.items()) <= 20 and all(k <= most[i] for i, k in got.items())
        assert sum(prices[i] * k for i, k in got.items()) == pytest.approx(best)


def test_token_sizes(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hello world"), (4, "<|endoftext|>"), (5, "a" * 300_000), (6, " " * 100_000)], "doc_id bigint, text string")
    found = {r["doc_id"]: r["n_tokens"] for r in token_sizes(df).collect()}
    assert (found[1], found[2], found[3]) == (0, 0, 2) and found[4] > 1 and found[5] > 1000 and len(found) == 6


def test_fullest_against_enumeration():
    from itertools import product

    r = random.Random(4)
    for _ in range(60):
        sizes = np.array(sorted(r.sample(range(1, 30), 4)), np.int64)
        most = np.array([r.randrange(4) for _ in range(4)], np.int64)
        room = r.randrange(60)
        found = fullest(sizes, most, room)
        assert all(0 < k <= most[i] for i, k in found.items())
        sums = [sum(k * int(s) for k, s in zip(ks, sizes)) for ks in product(*(range(m + 1) for m in most))]
        assert sum(k * int(sizes[i]) for i, k in found.items()) == max(x for x in sums if x <= room)


def test_bound_of_the_dual_program():
    """Where volume tells little, the prices do: seven items of three fifths need a container each."""
    plan, bound = solve({6: 7}, 10)
    assert (sum(n for _, n in plan), bound) == (7, 7)
    plan, bound = solve({6: 400, 4: 100, 5: 51}, 10)
    used = sum(n for _, n in plan)
    assert used == 426 and bound >= 0.98 * used
    assert solve({}, 10) == ([], 0)


def test_large_capacity(spark):
    r = random.Random(8)
    sizes = {i: r.randrange(1, 300_000) for i in range(300)} | {300: 2_400_000} | {301: 1_000_000, 302: 1_000_001}
    found = pack(spark.createDataFrame(list(sizes.items()), "doc_id bigint, n_tokens bigint"), 1_000_000).collect()
    used = check(found, sizes, 1_000_000)
    assert used <= 1.02 * sum(sizes.values()) / 1_000_000 + 1
