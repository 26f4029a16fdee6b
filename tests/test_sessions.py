import random

import pytest
from helpers import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.operators.sessions import NO_PARENT, cut_sessions, gap_tree, open_atoms, tree_nodes

COLUMNS = ("user_id", "session_start", "session_end", "duration_s", "actions")


def brute(actions, gap):
    by = {}
    for u, t in actions:
        if u is not None and t is not None:
            by.setdefault(u, []).append(t)
    out = []
    for u, ts in by.items():
        ts.sort()
        start = prev = ts[0]
        n = 0
        for t in ts:
            if t - prev > gap:
                out.append((u, start, prev, prev - start, n))
                start, n = t, 0
            prev, n = t, n + 1
        out.append((u, start, prev, prev - start, n))
    return sorted(out)


def frame(spark, actions):
    return spark.createDataFrame(actions, "user_id string, ts bigint").selectExpr("user_id", "ts", "1 as gap", "'x' as actions")


@pytest.mark.parametrize("chunk", [7, 50, 1000, 10**9])
def test_any_threshold_from_one_tree(spark, chunk):
    r = random.Random(chunk)
    actions = [(f"u{int(r.paretovariate(0.7)) % 9}", r.randrange(3000)) for _ in range(1500)] + [("hot", t) for t in range(0, 800)] + [(None, 5), ("x", None), ("one", -7), ("one", -7)]
    tree = gap_tree(frame(spark, actions), chunk_s=chunk).persist()
    for gap in (0, 1, 2, 5, 17, 100, 5000):
        assert rows(cut_sessions(tree, gap), *COLUMNS) == brute(actions, gap), gap
    assert tree.filter(f"parent_gap = {NO_PARENT}").count() == len({u for u, t in actions if u and t is not None})


def test_empty_and_arguments(spark):
    assert cut_sessions(gap_tree(frame(spark, [])), 10).count() == 0
    with pytest.raises(ValueError):
        gap_tree(frame(spark, []), chunk_s=0)
    with pytest.raises(ValueError):
        cut_sessions(gap_tree(frame(spark, [])), -1)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, unique=True), st.integers(1, 60))
def test_chunks_give_the_same_tree(times, chunk):
    import numpy as np

    times.sort()
    whole = sorted(tree_nodes([(t, t, 1, True) for t in times]))
    found, atoms = [], []
    for c in sorted({t // chunk for t in times}):
        own = np.array([t for t in times if t // chunk == c])
        found += [n for n in tree_nodes([(int(t), int(t), 1, True) for t in own]) if n[0] > own[0] and n[1] < own[-1]] if len(own) > 2 else []
        atoms += open_atoms(own, np.ones(len(own), np.int64))
    assert sorted(found + tree_nodes(atoms)) == whole


def test_open_atoms_are_few():
    import numpy as np

    ts = np.arange(86_400)
    assert len(open_atoms(ts, np.ones(len(ts), np.int64))) <= 4
    r = np.random.default_rng(1)
    ts = np.unique(r.integers(0, 86_400, 5000))
    assert len(open_atoms(ts, np.ones(len(ts), np.int64))) < 2 * (2 * 86_400) ** 0.5
