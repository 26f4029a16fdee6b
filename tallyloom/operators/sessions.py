"""Grouping activity into sessions by a Cartesian tree over the gaps between successive actions.

The tree of an entity has one leaf for each distinct second with actions and one inner node for each maximal run of actions whose largest gap is ``gap``; equal
gaps share a node. A node row holds its extent, its actions, its own gap and the gap of its parent. The sessions for a threshold t are the nodes with
``gap <= t < parent_gap``: a filter on the stored tree, so one tree serves any number of thresholds.

Large entities are cut into chunks of time. A chunk's tree is built alone; all nodes that touch neither end of the chunk are final. Of the rest only the strict
record gaps from either end matter to the neighbours. Their sum is at most the chunk's length, so there are fewer than ``2 * sqrt(2 * chunk_s)`` of them in a
chunk however many actions it holds, and a second pass over these merges the chunks of each entity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.time import DAY_S
from tallyloom.session import materialize, ship_package

#: Parent gap of a root: larger than any threshold.
NO_PARENT = 2**63 - 1
NODE_SCHEMA = "user_id string, start_ts bigint, end_ts bigint, actions bigint, gap bigint, parent_gap bigint"
_NODE_NAMES = ("user_id", "start_ts", "end_ts", "actions", "gap", "parent_gap")


class _Tree:
    """One pass over atoms (start, end, actions, emit) of one entity in order of time. Holds the open right spine only, whose gaps decrease strictly."""

    __slots__ = ("current", "rows", "spine")

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.spine: list[list] = []
        self.current: list | None = None

    def add(self, start: int, end: int, actions: int, emit: bool) -> None:
        cur, spine, rows = self.current, self.spine, self.rows
        if cur is not None:
            gap = start - cur[1]
            while spine and spine[-1][3] < gap:
                top = spine.pop()
                if cur[4]:
                    rows.append((cur[0], cur[1], cur[2], cur[3], top[3]))
                cur = [top[0], cur[1], top[2] + cur[2], top[3], True]
            if cur[4]:
                rows.append((cur[0], cur[1], cur[2], cur[3], gap))
            if spine and spine[-1][3] == gap:
                spine[-1][2] += cur[2]
            else:
                spine.append([cur[0], 0, cur[2], gap])
        self.current = [start, end, actions, 0, emit]

    def close(self) -> list[tuple]:
        cur = self.current
        while self.spine:
            top = self.spine.pop()
            if cur[4]:
                self.rows.append((cur[0], cur[1], cur[2], cur[3], top[3]))
            cur = [top[0], cur[1], top[2] + cur[2], top[3], True]
        if cur[4]:
            self.rows.append((cur[0], cur[1], cur[2], cur[3], NO_PARENT))
        return self.rows


def tree_nodes(atoms: list[tuple[int, int, int, bool]]) -> list[tuple[int, int, int, int, int]]:
    """(start, end, actions, gap, parent gap) of each node over atoms in order of time."""
    t = _Tree()
    for a in atoms:
        t.add(*a)
    return t.close() if atoms else []


def open_atoms(ts: np.ndarray, actions: np.ndarray) -> list[tuple[int, int, int, bool]]:
    """The chunk's actions cut at the strict record gaps from either end: all that the neighbouring chunks need of it."""
    n = len(ts)
    gaps = np.diff(ts)
    if len(gaps):
        highest = np.maximum.accumulate(gaps)
        first = np.concatenate([[True], gaps[1:] > highest[:-1]])
        highest = np.maximum.accumulate(gaps[::-1])
        last = np.concatenate([[True], gaps[::-1][1:] > highest[:-1]])[::-1]
        cuts = np.flatnonzero(first | last) + 1
    else:
        cuts = np.empty(0, np.int64)
    starts = np.concatenate([[0], cuts])
    ends = np.concatenate([cuts, [n]]) - 1
    total = np.concatenate([[0], np.cumsum(actions)])
    sums = total[ends + 1] - total[starts]
    # Only a leaf at either end of the chunk is still to be reported; whatever else makes up an atom has been.
    return [(int(ts[a]), int(ts[b]), int(k), bool(a == b and (a == 0 or b == n - 1))) for a, b, k in zip(starts, ends, sums)]


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, dict[str, np.ndarray]]]:
    """Runs of equal keys in sorted batches, joined across batch borders."""
    held: tuple | None = None
    parts: list[dict[str, np.ndarray]] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = {name: batch.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(batch.schema.names)}
        change = np.zeros(n, bool)
        for k in keys:
            change[1:] |= cols[k][1:] != cols[k][:-1]
        borders = [0, *np.flatnonzero(change).tolist(), n]
        for a, b in zip(borders, borders[1:]):
            key = tuple(cols[k][a] for k in keys)
            if held is not None and key != held:
                yield held, {c: np.concatenate([p[c] for p in parts]) if len(parts) > 1 else parts[0][c] for c in parts[0]}
                parts = []
            held = key
            parts.append({c: v[a:b] for c, v in cols.items() if c not in keys})
    if held is not None:
        yield held, {c: np.concatenate([p[c] for p in parts]) if len(parts) > 1 else parts[0][c] for c in parts[0]}


class _Out:
    """Columns of result rows, handed on as batches."""

    def __init__(self, schema: pa.Schema, size: int = 50_000) -> None:
        self.schema, self.size = schema, size
        self.cols: list[list] = [[] for _ in schema]

    def full(self) -> bool:
        return len(self.cols[0]) >= self.size

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.cols, self.schema)], schema=self.schema)
        self.cols = [[] for _ in self.schema]
        return out


_CHUNK_OUT = pa.schema([("user_id", pa.string()), ("start_ts", pa.int64()), ("end_ts", pa.int64()), ("actions", pa.int64()), ("gap", pa.int64()), ("parent_gap", pa.int64()), ("open", pa.bool_()), ("emit", pa.bool_())])
_NODE_OUT = pa.schema([_CHUNK_OUT.field(i) for i in range(6)])


def _chunk_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (user_id, chunk, ts, actions) to the final nodes of each chunk and its open atoms."""
    out = _Out(_CHUNK_OUT)
    u, s, e, a, g, p, o, m = range(8)
    for (user, _), cols in _groups(batches, ["user_id", "chunk"]):
        ts, actions = cols["ts"], cols["actions"]
        c = out.cols
        if len(ts) > 2:
            first, last = int(ts[0]), int(ts[-1])
            t = _Tree()
            add = t.add
            for x, k in zip(ts.tolist(), actions.tolist()):
                add(x, x, k, True)
            final = [r for r in t.close() if r[0] > first and r[1] < last]
            n = len(final)
            if n:
                for i, col in enumerate(zip(*final)):
                    c[s + i].extend(col)
                c[u].extend([user] * n)
                c[o].extend([False] * n)
                c[m].extend([True] * n)
        for start, end, k, emit in open_atoms(ts, actions):
            c[u].append(user)
            c[s].append(start)
            c[e].append(end)
            c[a].append(k)
            c[g].append(0)
            c[p].append(0)
            c[o].append(True)
            c[m].append(emit)
        if out.full():
            yield out.batch()
            c = out.cols
    yield out.batch()


def _merge_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted open atoms (user_id, start_ts, end_ts, actions, emit) to the nodes that reach a chunk's end. Streams; holds one spine and one batch."""
    out = _Out(_NODE_OUT)
    tree, held = None, None

    def flush(rows: list[tuple]) -> None:
        if rows:
            for i, col in enumerate(zip(*rows)):
                out.cols[1 + i].extend(col)
            out.cols[0].extend([held] * len(rows))

    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(5)]
        for user, start, end, actions, emit in zip(*cols):
            if user != held:
                if tree is not None:
                    flush(tree.close())
                tree, held = _Tree(), user
            elif len(tree.rows) >= 10_000:
                flush(tree.rows)
                tree.rows = []
            tree.add(start, end, actions, emit)
            if out.full():
                yield out.batch()
    if tree is not None:
        flush(tree.close())
    yield out.batch()


def gap_tree(actions: DataFrame, chunk_s: int = 7 * DAY_S, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """The Cartesian tree of every entity as node rows: user_id, start_ts, end_ts, actions, gap, parent_gap.

    actions: one row per action (repeats count as actions of their own); other columns are ignored. Rows with a null entity or time are left out; an empty
    input gives an empty tree; an entity with one action gives one leaf with gap 0 and the largest bigint as parent gap; ties in time are one leaf.

    Two shuffles carry the data: counts by (entity, second), combined in each task first, and the chunks; a chunk has at most chunk_s rows whatever the skew.
    """
    if chunk_s < 1:
        raise ValueError("chunk_s must be positive")
    ship_package(actions.sparkSession)
    u, t = F.col(f"`{user}`").cast("string"), F.col(f"`{ts}`").cast("bigint")
    seconds = actions.select(u.alias("user_id"), t.alias("ts")).filter("user_id is not null and ts is not null").groupBy("user_id", "ts").agg(F.count(F.lit(1)).alias("actions"))
    chunk = F.call_function("div", F.col("ts") - F.pmod("ts", F.lit(chunk_s).cast("bigint")), F.lit(chunk_s).cast("bigint"))
    built = (
        seconds.withColumn("chunk", chunk)
        .repartition("user_id", "chunk")
        .sortWithinPartitions("user_id", "chunk", "ts")
        .select("user_id", "chunk", "ts", "actions")
        .mapInArrow(_chunk_trees, NODE_SCHEMA + ", open boolean, emit boolean")
    )
    built = materialize(built, "chunk-trees")
    merged = (
        built.filter("open").select("user_id", "start_ts", "end_ts", "actions", "emit").repartition("user_id").sortWithinPartitions("user_id", "start_ts").mapInArrow(_merge_trees, NODE_SCHEMA)
    )
    return built.filter("not open").select(*_NODE_NAMES).unionByName(merged)


def cut_sessions(tree: DataFrame, threshold_s: int) -> DataFrame:
    """Sessions of a gap tree: user_id, session_start, session_end, duration_s, actions. Successive actions at most threshold_s seconds apart share a session.

    A plain filter, pushed down to a stored tree; a threshold below 0 is refused, 0 gives one session per second with actions.
    """
    if threshold_s < 0:
        raise ValueError("threshold_s must not be negative")
    return tree.filter((F.col("gap") <= threshold_s) & (F.col("parent_gap") > threshold_s)).select(
        "user_id",
        F.col("start_ts").alias("session_start"),
        F.col("end_ts").alias("session_end"),
        (F.col("end_ts") - F.col("start_ts")).alias("duration_s"),
        "actions",
    )
