"""Filling containers of fixed capacity with items of whole-number sizes.

Only the histogram of sizes, at most ``capacity`` numbers, decides which sizes share a container; it alone reaches the driver. The configuration linear program over
it (cover the count of every size with as few configurations as possible) is solved by multiplicative weights: each size has a price that falls exponentially
with the share of it that is covered, the configuration of the greatest price is found by dynamic programming for the knapsack, and taken in part. Prices divided by the value of
their best configuration are a solution of the dual program, so every round also bounds from below how many containers any packing needs. The
fractional solution is rounded down; what remains is packed around its largest sizes, each container as full as sums of the sizes left can make it. Rounds go on until the
result is proven to be within a gap of the bound, or the program is solved. Every item then finds its container by
its rank among the items of its size, computed in salted shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import materialize, ship_package, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Cells of the dynamic program; a larger capacity is counted in units of several, and sizes rounded up to them.
CELLS = 1 << 14
_loaded: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _loaded[path] = t
    return _loaded[path]


def token_sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id and n_tokens of each row; null and empty texts have 0. tokenizer: a file of a public tokenizer that every executor can read."""
    ship_package(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(tokenizer)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            sizes: list[int] = []
            for i in range(0, len(texts), 256):  # encodings are large, so few at a time
                sizes += [len(e.ids) for e in t.encode_batch_fast(texts[i : i + 256], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])

    return spread(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "doc_id").mapInArrow(count, f"doc_id {dict(docs.dtypes)[doc_id]}, n_tokens bigint")


def best_configuration(sizes: np.ndarray, prices: np.ndarray, most: np.ndarray, capacity: int) -> dict[int, int]:
    """Index of a size to its number in the configuration of the greatest total price, by dynamic programming over the capacity; at most most[i] of size i. Above CELLS the
    capacity is counted in units, so the configuration fits but may not be the best."""
    if capacity > CELLS:
        unit = -(-capacity // CELLS)
        sizes, capacity = -(-sizes // unit), capacity // unit
    keep = np.flatnonzero((most > 0) & (prices > 0) & (sizes <= capacity))
    order = keep[np.lexsort((-prices[keep], sizes[keep]))]
    value = np.zeros(capacity + 1)
    steps: list[tuple[int, int, np.ndarray]] = []
    kept_price, kept_room, m = np.empty(len(order)), np.empty(len(order)), 0
    for i in order:
        s, p = int(sizes[i]), prices[i]
        # If smaller sizes of no lower price fill what this one would leave, one of them is always free to take its place.
        if m and kept_room[:m][kept_price[:m] >= p].sum() > capacity - s:
            continue
        n = int(min(most[i], capacity // s))
        kept_price[m], kept_room[m] = p, float(most[i]) * s
        m += 1
        k = 1
        while n > 0:  # 1, 2, 4, ... of it at a time
            k = min(k, n)
            w = k * s
            with_it = value[: capacity + 1 - w] + k * p
            better = with_it > value[w:] + 1e-12
            if better.any():
                value[w:][better] = with_it[better]
                steps.append((int(i), k, better))
            n -= k
            k *= 2
    at = int(np.argmax(value))
    found: dict[int, int] = {}
    for i, k, better in reversed(steps):
        w = k * int(sizes[i])
        if at >= w and better[at - w]:
            found[i] = found.get(i, 0) + k
            at -= w
    return found


def fullest(sizes: np.ndarray, most: np.ndarray, room: int) -> dict[int, int]:
    """Index of a size to its number in the configuration that fills a room best, at most most[i] of size i: the sums that can be reached are the bits of one whole number, and
    larger sizes go first."""
    reached, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for i in np.flatnonzero((most > 0) & (sizes <= room))[::-1].tolist():
        s = int(sizes[i])
        n, k = min(int(most[i]), room // s), 1
        while n > 0:  # 1, 2, 4, ... of it at a time
            k = min(k, n)
            more = (reached | reached << k * s) & mask
            if more != reached:
                steps.append((i, k, reached))
                reached = more
            n -= k
            k *= 2
        if reached >> room:
            break
    at = reached.bit_length() - 1
    found: dict[int, int] = {}
    for i, k, before in reversed(steps):
        if not before >> at & 1:
            found[i] = found.get(i, 0) + k
            at -= k * int(sizes[i])
    return found


def solve(histogram: dict[int, int], capacity: int, gap: float = 0.001, rate: float = 8.0, part: float = 0.5, batch: int = 50) -> tuple[list[tuple[dict[int, int], int]], int]:
    """Configurations (size to number) and how many containers have each, that together hold the histogram exactly, and a number of containers that every packing needs at least.

    gap: share by which the result may exceed that number; within one container is always good enough. Where no rounds of the program bring it there, the best of all rounds
    counts. rate and part: how fast a price falls, and which part of the largest possible amount a round takes. batch: rounds before the first test, twice as many before each further one.
    """
    sizes = np.array(sorted(s for s, n in histogram.items() if s > 0 and n > 0), np.int64)
    count = np.array([histogram[int(s)] for s in sizes], np.int64)
    if not len(sizes):
        return [], 0
    if sizes[-1] > capacity:
        raise ValueError("a size exceeds the capacity")
    bound = -(-sum(int(s) * int(n) for s, n in zip(sizes, count)) // capacity)
    need = count.astype(float)
    covered = np.zeros(len(sizes))
    parts: list[tuple[dict[int, int], float]] = []
    best: list[tuple[dict[int, int], int]] | None = None
    while True:
        for _ in range(batch):
            open_ = covered < 1 - 1e-9
            if not open_.any():
                break
            prices = np.where(open_, sizes / capacity * np.exp(-rate * covered), 0)
            # A size that fills the capacity may round up beyond it; it goes alone.
            config = best_configuration(sizes, prices, count * open_, capacity) or {int(np.flatnonzero(open_)[-1]): 1}
            if capacity <= CELLS:
                # The number of copies is bounded in a configuration as it is in the histogram, which the covering program may ask for as well.
                value = sum(prices[i] * k for i, k in config.items())
                bound = max(bound, int(np.ceil(float(need @ prices) / value * (1 - 1e-9))))
            most = min((1 - covered[i]) * need[i] / k for i, k in config.items())
            amount = most if most < 1 else max(1.0, most * part)
            for i, k in config.items():
                covered[i] += amount * k / need[i]
            parts.append((config, amount))
        plan = _rounded(sizes, count, parts, capacity)
        if best is None or sum(n for _, n in plan) < sum(n for _, n in best):
            best = plan
        used = sum(n for _, n in best)
        if used <= bound + 1 or used <= (1 + gap) * bound or not (covered < 1 - 1e-9).any():
            return best, bound
        batch *= 2


def _rounded(sizes: np.ndarray, count: np.ndarray, parts: list[tuple[dict[int, int], float]], capacity: int) -> list[tuple[dict[int, int], int]]:
    """The fractional solution rounded down, and containers for what it leaves."""
    left = count.copy()
    plan: dict[tuple, int] = {}

    def take(config: dict[int, int], copies: int) -> None:
        for i, k in config.items():
            left[i] -= k * copies
        key = tuple(sorted((int(sizes[i]), k) for i, k in config.items()))
        plan[key] = plan.get(key, 0) + copies

    for config, amount in parts:
        copies = min(int(amount + 1e-9), *(int(left[i]) // k for i, k in config.items()))
        if copies > 0:
            take(config, copies)
    while left.any():
        # The largest size left is the hardest to place, so it goes first and the rest of its container is filled as well as can be.
        top = int(np.flatnonzero(left)[-1])
        others = left.copy()
        others[top] -= 1
        config = fullest(sizes, others, capacity - int(sizes[top]))
        config[top] = config.get(top, 0) + 1
        take(config, min(int(left[i]) // k for i, k in config.items()))
    return [(dict(key), n) for key, n in sorted(plan.items(), key=lambda x: (-sum(s * k for s, k in x[0]), x[0]))]


def plan_containers(histogram: dict[int, int], capacity: int, **options) -> list[tuple[dict[int, int], int]]:
    """The plan of solve."""
    return solve(histogram, capacity, **options)[0]


class _Places:
    """Container, place and offset of the item with a rank among those of its size."""

    def __init__(self, plan: list[tuple[dict[int, int], int]]) -> None:
        rows, used = [], {}
        first = 0
        self.firsts, self.counts = [], []
        for config, copies in plan:
            place = offset = 0
            for s in sorted(config, reverse=True):
                k = config[s]
                rows.append((s, used.get(s, 0), first, k, place, offset))
                used[s] = used.get(s, 0) + k * copies
                place += k
                offset += k * s
            self.firsts.append(first)
            self.counts.append(place)
            first += copies
        self.containers = first
        self.rows = np.array(sorted(rows) or [(0,) * 6], np.int64)
        # Items are numbered through, smaller sizes first.
        self.sizes = np.array(sorted(used) or [0], np.int64)
        self.before = np.concatenate([[0], np.cumsum([used[s] for s in sorted(used)])]).astype(np.int64)
        self.keys = self.before[np.searchsorted(self.sizes, self.rows[:, 0])] + self.rows[:, 1]

    def find(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        number = self.before[np.minimum(np.searchsorted(self.sizes, size), len(self.sizes) - 1)] + rank
        r = self.rows[np.maximum(np.searchsorted(self.keys, number, side="right") - 1, 0)]
        q = rank - r[:, 1]
        k = np.maximum(r[:, 3], 1)
        container, place, offset = r[:, 2] + q // k, r[:, 4] + q % k, r[:, 5] + q % k * r[:, 0]
        empty = size == 0
        if empty.any():  # items without size go round all containers, behind the others
            n = max(1, self.containers)
            c = rank[empty] % n
            container[empty] = c
            of = np.searchsorted(np.array(self.firsts or [0]), c, side="right") - 1
            place[empty] = np.array(self.counts or [0])[of] + rank[empty] // n
            offset[empty] = 0
        return container, place, offset


def pack(sizes: DataFrame, capacity: int, item: str = "doc_id", size: str = "n_tokens", shards: int = 64) -> DataFrame:
    """item, piece, container_id, place, start_offset, n_tokens: where each item goes.

    An item larger than the capacity is cut into pieces, all but the last of full capacity; no other item is cut. A null or negative size counts as 0, and items of
    size 0 are spread evenly over all containers, behind the others. Ties are broken by item, so the result is the same each time; items should be unique (repeated ones get places of
    their own). An empty table gives no rows. shards: parts in which the items of one size are ranked, so that a size may hold a third of all items.
    """
    if capacity < 1 or shards < 1:
        raise ValueError("capacity and shards must be positive")
    spark = sizes.sparkSession
    ship_package(spark)
    whole = F.greatest(F.coalesce(F.col(f"`{size}`").cast("bigint"), F.lit(0)), F.lit(0))
    c = F.lit(capacity).cast("bigint")
    last = F.greatest(F.ceil(whole / c).cast("bigint") - 1, F.lit(0).cast("bigint"))
    items = sizes.select(F.col(f"`{item}`").alias("_item"), whole.alias("_whole"), last.alias("_last"))
    pieces = items.select("_item", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_last"))).alias("piece"), "_whole").select(
        "_item", "piece", F.least(c, F.col("_whole") - F.col("piece") * c).alias("_size"), F.pmod(F.xxhash64("_item", "piece"), F.lit(shards)).cast("int").alias("_shard")
    )
    counts = materialize(pieces.groupBy("_size", "_shard").agg(F.count(F.lit(1)).alias("_n")), "size-counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("_size").agg(F.sum("_n")).collect()}  # at most capacity + 1 rows
    shared = spark.sparkContext.broadcast(plan_containers(histogram, capacity))
    before = Window.partitionBy("_size").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_size", "_shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = (
        pieces.withColumn("_rank", F.row_number().over(Window.partitionBy("_size", "_shard").orderBy("_item", "piece")) - 1)
        .join(offsets, ["_size", "_shard"])
        .select("_item", "piece", "_size", (F.col("_rank") + F.col("_before")).cast("bigint").alias("_rank"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places(shared.value)
        for b in batches:
            s, r = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            found = places.find(s, r)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, pa.int64()) for x in found), b.column(2)], names=["item", "piece", "container_id", "place", "start_offset", "n_tokens"])

    kind = dict(sizes.dtypes)[item]
    return ranked.mapInArrow(place, f"item {kind}, piece bigint, container_id bigint, place bigint, start_offset bigint, n_tokens bigint").withColumnRenamed("item", item)
