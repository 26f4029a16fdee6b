"""Analytics of the co-purchase graph, in which two users are linked if they bought in a common category.

The graph of users is quadratic in the size of a category, so it isn't built. Users who bought in the same set of categories have the same neighbours; they form
one class, and the graph of classes with class sizes carries everything: an edge between classes stands for all links between their members, degrees and
PageRank are equal within a class, and components follow from the links between users and categories. Links count in both directions.

Classes come in blocks of bounded size, hashed, so that no category, however hot, decides how work is spread. Each pair of blocks meets once, and a product of their
membership matrices gives the common categories of all pairs of their classes. Degrees and PageRank keep of it one bit a pair, multiply it with a vector of the classes in
each round, and build no edges; only ``edges`` itself, whose result they are, writes them out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import materialize, ship_package

#: Classes of a block at most, as a rule: blocks are hashed. Fewer if there are fewer than eight such blocks.
BLOCK = 4096
#: Categories of one product of membership matrices.
COLUMNS = 2048
_EDGES = pa.schema([("src", pa.string()), ("dst", pa.string()), ("weight", pa.int64()), ("links", pa.int64())])
_BITS = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("n_i", pa.int32()), ("n_j", pa.int32()), ("bits", pa.binary())])
_PARTS = pa.schema([("block", pa.int32()), ("part", pa.list_(pa.float64()))])


def vertices(log: DataFrame) -> DataFrame:
    """Every user of the log, buyer or not, with a long id that is not negative: a hash of 63 bits."""
    return log.select("user_id").distinct().select(F.xxhash64("user_id").bitwiseAND(F.lit(2**63 - 1)).alias("vertex_id"), "user_id")


def user_categories(log: DataFrame) -> DataFrame:
    """Distinct (user_id, category) of purchases."""
    return log.filter("behavior = 'buy'").select("user_id", "category").distinct()


def classes(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Membership (user_id, class_id) of buyers, and classes (class_id, class_no, categories, members). The id is the least user of the class, the number a bigint."""
    sets = materialize(user_categories(log).groupBy("user_id").agg(F.sort_array(F.collect_set("category")).alias("categories")), "user-sets")
    found = materialize(sets.groupBy("categories").agg(F.min("user_id").alias("class_id"), F.count(F.lit(1)).alias("members")).withColumn("class_no", F.monotonically_increasing_id()), "classes")
    return sets.join(found, "categories").select("user_id", "class_id"), found.select("class_id", "class_no", "categories", "members")


def _blocks(class_table: DataFrame) -> tuple[DataFrame, int]:
    """block, ids, members and sets (the numbers of each class's categories) of every block, and how many blocks there are."""
    n = class_table.count()
    blocks = max(1, -(-n // min(BLOCK, max(1, -(-n // 8)))))
    flat = class_table.select("class_id", "members", F.explode("categories").alias("category"))
    # The distinct categories of a shop; numbers make them columns of a matrix.
    numbers = materialize(flat.select("category").distinct().groupBy().agg(F.sort_array(F.collect_set("category")).alias("all")).select(F.posexplode("all").alias("number", "category")), "category-numbers")
    sets = flat.join(numbers, "category").groupBy("class_id", "members").agg(F.collect_list("number").alias("set"))
    block = F.pmod(F.xxhash64("class_id"), F.lit(blocks)).cast("int").alias("block")
    found = sets.select(block, F.struct("class_id", "members", "set").alias("c")).groupBy("block").agg(F.sort_array(F.collect_list("c")).alias("c"))
    return materialize(found.select("block", F.col("c.class_id").alias("ids"), F.col("c.members").alias("members"), F.col("c.set").alias("sets")), "class-blocks"), blocks


def _pairs_of_blocks(blocks: DataFrame, n: int) -> DataFrame:
    """Every pair of blocks i <= j once, in as many partitions as there are pairs up to 10,000."""
    left = blocks.select(F.col("block").alias("i"), F.col("ids").alias("ids_i"), F.col("members").alias("members_i"), F.col("sets").alias("sets_i"), F.explode(F.sequence(F.col("block"), F.lit(n - 1))).alias("j"))
    right = blocks.select(F.col("block").alias("j"), F.col("ids").alias("ids_j"), F.col("members").alias("members_j"), F.col("sets").alias("sets_j"))
    met = left.join(right, "j").select("i", "j", "ids_i", "members_i", "sets_i", "ids_j", "members_j", "sets_j")
    return met.repartition(max(1, min(n * (n + 1) // 2, 10_000)), "i", "j")


def _common(sets_i: pa.Array, sets_j: pa.Array) -> np.ndarray:
    """How many numbers each list of one array has in common with each of another."""
    flat = [(x.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(x)), np.diff(x.offsets.to_numpy()))) for x in (sets_i, sets_j)]
    shared = np.intersect1d(flat[0][0], flat[1][0])
    out = np.zeros((len(sets_i), len(sets_j)), np.float32)
    for at in range(0, len(shared), COLUMNS):
        part = shared[at : at + COLUMNS]
        sides = []
        for (numbers, rows), n in zip(flat, out.shape):
            own = np.isin(numbers, part)
            m = np.zeros((n, len(part)), np.float32)
            m[rows[own], np.searchsorted(part, numbers[own])] = 1.0
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """Each row of batches, with lists as arrays."""
    for b in batches:
        for k in range(b.num_rows):
            yield [c[k].values if pa.types.is_list(c.type) else c[k].as_py() for c in b.columns]


def _edges_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for i, j, ids_i, members_i, sets_i, ids_j, members_j, sets_j in _rows(batches):
        common = _common(sets_i, sets_j)
        m_i, m_j = members_i.to_numpy(), members_j.to_numpy()
        # Ranks of the ids, as an edge begins at its lesser end.
        both = np.array([*ids_i.to_pylist(), *ids_j.to_pylist()], object)
        rank = np.empty(len(both), np.int64)
        rank[np.argsort(both, kind="stable")] = np.arange(len(both))
        r_i, r_j = rank[: len(m_i)], rank[len(m_i) :]
        step = max(1, 500_000 // max(1, len(m_j)))
        for at in range(0, len(m_i), step):
            x, y = np.nonzero(common[at : at + step])
            w = common[at : at + step][x, y].astype(np.int64)
            x = x + at
            if i == j:
                keep = x <= y
                x, y, w = x[keep], y[keep], w[keep]
            own = (x == y) & (i == j)
            links = np.where(own, m_i[x] * (m_i[x] - 1) // 2, m_i[x] * m_j[y])
            swap = (r_i[x] > r_j[y]) & ~own
            a, b = ids_i.take(pa.array(x)), ids_j.take(pa.array(y))
            mask = pa.array(swap)
            yield pa.RecordBatch.from_arrays([pc.if_else(mask, b, a), pc.if_else(mask, a, b), pa.array(w), pa.array(links)], schema=_EDGES)


def edges(class_table: DataFrame) -> DataFrame:
    """src, dst (src <= dst), weight and links: classes with a common category, how many categories they share, and how many links of users the edge stands for.

    The edge of a class with itself stands for the links among its members.
    """
    ship_package(class_table.sparkSession)
    return _pairs_of_blocks(*_blocks(class_table)).mapInArrow(_edges_of, "src string, dst string, weight bigint, links bigint")


def _bits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for i, j, _, members_i, sets_i, _, members_j, sets_j in _rows(batches):
        bits = np.packbits(_common(sets_i, sets_j) > 0, axis=1).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((i, j, len(members_i), len(members_j), bits), _BITS)], schema=_BITS)


def _multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for i, j, n_i, n_j, bits, x_i, x_j in _rows(batches):
        m = np.unpackbits(np.frombuffer(bits, np.uint8).reshape(n_i, -1), axis=1, count=n_j).astype(np.float32)
        parts = [(i, m @ x_j.to_numpy())]
        if i != j:
            parts.append((j, x_i.to_numpy() @ m))
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.list_(pa.float64()))], schema=_PARTS)


class _Links:
    """Which classes are linked, as bits by pairs of blocks."""

    def __init__(self, class_table: DataFrame) -> None:
        ship_package(class_table.sparkSession)
        self.blocks, n = _blocks(class_table)
        self.bits = materialize(_pairs_of_blocks(self.blocks, n).mapInArrow(_bits_of, "i int, j int, n_i int, n_j int, bits binary"), "link-bits")

    def sums(self, vectors: DataFrame) -> DataFrame:
        """block and y: for each class the sum of x over the classes linked with it, itself among them; vectors: block and x."""
        x = lambda end: vectors.select(F.col("block").alias(end), F.col("x").alias(f"x_{end}"))
        parts = self.bits.join(x("i"), "i").join(x("j"), "j").select("i", "j", "n_i", "n_j", "bits", "x_i", "x_j").mapInArrow(_multiply, "block int, part array<double>")

        def add(pdf):
            import pandas as pd

            return pd.DataFrame({"block": pdf["block"].iloc[:1], "y": [np.sum(np.stack(pdf["part"].to_list()), 0)]})

        return parts.groupBy("block").applyInPandas(add, "block int, y array<double>")

    def degrees(self) -> DataFrame:
        """block, ids, members and degree: how many others a member of each class is linked with."""
        y = self.sums(self.blocks.select("block", F.col("members").cast("array<double>").alias("x")))
        return self.blocks.drop("sets").join(y, "block").select("block", "ids", "members", F.transform("y", lambda d: d - 1).alias("degree"))


def with_unknown(ranked: DataFrame, vertex_table: DataFrame) -> DataFrame:
    """user_id of vertex_id; ends of edges that have no vertex are called Unknown."""
    return ranked.join(vertex_table, "vertex_id", "left").withColumn("user_id", F.coalesce("user_id", F.lit("Unknown")))


def degrees(class_table: DataFrame, edge_table: DataFrame | None = None) -> DataFrame:
    """class_id and degree of its members; members without links are missing. Links count in both directions, so it is the in-degree and the out-degree. edge_table isn't read; the
    degrees come from the blocks."""
    found = _Links(class_table).degrees().select(F.explode(F.arrays_zip("ids", "degree")).alias("c"))
    return found.select(F.col("c.ids").alias("class_id"), F.round("c.degree").cast("bigint").alias("degree")).filter("degree > 0")


def pagerank(class_table: DataFrame, edge_table: DataFrame | None, all_users: int, rounds: int = 20, tolerance: float | None = None, reset: float = 0.15) -> DataFrame:
    """class_id, members and rank of each: r = reset + (1 - reset) * sum of r(u) / degree(u) over neighbours u, from 1, for so many rounds or until no rank moves by
    tolerance; then scaled so that the ranks of all_users users add up to their number. Users without links have reset before scaling. edge_table isn't read; links come from the
    blocks. A round reads a bit for each pair of classes and shuffles a number for each class and block."""
    links = _Links(class_table)
    state = materialize(links.degrees().withColumn("rank", F.transform("degree", lambda d: F.when(d > 0, 1.0).otherwise(reset))), "ranks")
    for _ in range(rounds):
        given = state.withColumn("share", F.zip_with("rank", "degree", lambda r, d: F.when(d > 0, r / d).otherwise(0.0)))
        y = links.sums(given.select("block", F.zip_with("share", "members", lambda s, m: s * m).alias("x")))
        # Of the members of their own class everyone has one neighbour less.
        moved = given.join(y, "block").withColumn("y", F.zip_with("y", "share", lambda v, s: v - s))
        new = moved.withColumn("old", F.col("rank")).withColumn("rank", F.zip_with("y", "degree", lambda v, d: F.when(d > 0, F.lit(reset) + F.lit(1 - reset) * v).otherwise(reset)))
        state = materialize(new.select("block", "ids", "members", "degree", "rank", F.array_max(F.zip_with("rank", "old", lambda a, b: F.abs(a - b))).alias("moved")), "ranks")
        if tolerance is not None:
            most = state.agg(F.max("moved")).first()[0]
            if most is None or most < tolerance:
                break
    joined = state.select(F.explode(F.arrays_zip("ids", "members", "rank")).alias("c")).select(F.col("c.ids").alias("class_id"), F.col("c.members").alias("members"), F.col("c.rank").alias("rank"))
    total = joined.agg((F.sum(F.col("rank") * F.col("members")) + F.lit(reset) * (F.lit(all_users) - F.sum("members"))).alias("total"))
    return joined.join(F.broadcast(total), F.lit(True)).select("class_id", "members", (F.col("rank") * all_users / F.col("total")).alias("rank"))  # total is one row


def count_links(class_table: DataFrame) -> DataFrame:
    """edges: the number of linked pairs of users, without building any."""
    found = _Links(class_table).degrees().select(F.explode(F.arrays_zip("members", "degree")).alias("c"))
    return found.agg(F.call_function("div", F.sum(F.col("c.members") * F.round("c.degree").cast("bigint")), F.lit(2).cast("bigint")).alias("edges"))


def components(class_table: DataFrame, most: int = 50) -> DataFrame:
    """class_id and component, the least class of those connected through categories. Labels spread between classes and categories until none changes."""
    links = materialize(class_table.select("class_id", F.explode("categories").alias("category")), "links")
    labels = class_table.select("class_id", F.col("class_id").alias("component"))
    for _ in range(most):
        by_category = links.join(labels, "class_id").groupBy("category").agg(F.min("component").alias("low"))
        new = materialize(links.join(by_category, "category").groupBy("class_id").agg(F.min("low").alias("component")), "labels")
        changed = new.join(labels.select("class_id", F.col("component").alias("old")), "class_id").filter("component <> old").limit(1).count()
        labels = new
        if not changed:
            return labels
    raise RuntimeError("labels still change; raise most")


def user_components(log: DataFrame) -> DataFrame:
    """user_id and component of every user; a user without purchase is a component of their own."""
    members, class_table = classes(log)
    found = members.join(components(class_table), "class_id").select("user_id", "component")
    return log.select("user_id").distinct().join(found, "user_id", "left").select("user_id", F.coalesce("component", "user_id").alias("component"))


def component_sizes(user_table: DataFrame) -> DataFrame:
    """component and size, the largest first."""
    return user_table.groupBy("component").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "component")


def ranked_users(class_ranks: DataFrame, members: DataFrame, n: int | None = None) -> DataFrame:
    """user_id and rank; the n highest if n is given."""
    found = members.join(class_ranks.select("class_id", "rank"), "class_id").select("user_id", "rank")
    return found if n is None else found.orderBy(F.desc(F.round("rank", 6)), "user_id").limit(n)


__all__ = ["classes", "component_sizes", "components", "count_links", "degrees", "edges", "pagerank", "ranked_users", "user_categories", "user_components", "vertices", "with_unknown"]
