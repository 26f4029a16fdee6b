"""Items that appear together, kept as an incremental pair table.

A store holds, for each period, basket contents, the number of baskets, the marginal count of each item and the counts of pairs, all in hash buckets. A batch of
changes turns each changed basket into signed deltas of pairs and marginals; they merge into the buckets they fall into, and only the scores of the periods
concerned are computed again.

A store lives in its folder: the tables in folders of their own for each batch, and a manifest that says which of them hold each (period, bucket). A batch ends with the
manifest's next version, put in place by one rename that fails if another writer was first. So a store can be opened again at any time, a batch that fails leaves it
as it was, and nothing that a manifest names is ever written again. A manifest has one entry for each period and bucket of a table: it grows with the days kept, not
with the rows.

Baskets of more than ``heavy`` items emit no pairs, as their number is quadratic. The store keeps them as item lists instead, and scoring adds their share
exactly: pairs that can still reach the wanted count and lift are looked up in the heavy lists, and pairs that occur in heavy baskets only are found with a
prefix filter: two items that share k of the baskets share one of the first |H| - k + 1 of either list in any fixed order.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.session import materialize, new_path

#: Rows of one side of a block when the lists of a heavy basket meet.
BLOCK = 1000
_TABLES = {
    "baskets": "basket string, item string, period string, bucket int",
    "heavy": "basket string, item string, period string, bucket int",
    "items": "item string, n bigint, period string, bucket int",
    "periods": "n bigint, period string, bucket int",
    "pairs": "item_a string, item_b string, n bigint, period string, bucket int",
}


def _pairs_of(members: str) -> Column:
    """item_a, item_b, delta of the array of (item, was, now), sorted by item, where the delta isn't 0."""
    return F.expr(
        f"""filter(flatten(transform({members}, (x, i) -> transform(slice({members}, i + 2, size({members})),
            y -> struct(x.item as item_a, y.item as item_b, int(x.now and y.now) - int(x.was and y.was) as delta)))), p -> p.delta != 0)"""
    )


class PairStore:
    """Persistent counts of baskets, items and pairs per period.

    path: the store's folder; a store that is there already is opened, with the settings it was made with. heavy: baskets of more items keep lists rather than
    pairs; it bounds the pairs a basket emits, not the result. buckets: hash buckets of each period.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 8, heavy: int = 100) -> None:
        if buckets < 1 or heavy < 1:
            raise ValueError("buckets and heavy must be positive")
        self.spark, self.path, self.buckets, self.heavy = spark, (path or new_path(spark, "pairs")).rstrip("/"), buckets, heavy
        #: Of each table: the folder that holds a (period, bucket).
        self.manifest: dict[str, dict[tuple[str, int], str]] = {t: {} for t in _TABLES}
        self.version = 0
        self.refresh()

    # The folder

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def refresh(self) -> None:
        """Takes up the newest version, which another object or application may have written."""
        found, fs = self._fs(f"{self.path}/manifest")
        newest = max((int(x.getPath().getName()[:-5]) for x in fs.listStatus(found) if x.getPath().getName().endswith(".json")), default=0) if fs.exists(found) else 0
        if newest == self.version:
            return
        text = self.spark.read.text(f"{self.path}/manifest/{newest:012d}.json", wholetext=True).first()[0]
        kept = json.loads(text)
        self.version, self.buckets, self.heavy = newest, kept["buckets"], kept["heavy"]
        self.manifest = {t: {(p, b): folder for folder, keys in kept["tables"][t].items() for p, b in keys} for t in _TABLES}

    def _commit(self, manifest: dict[str, dict[tuple[str, int], str]]) -> None:
        tables: dict[str, dict[str, list]] = {t: {} for t in _TABLES}
        for t, keys in manifest.items():
            for key, folder in sorted(keys.items()):
                tables[t].setdefault(folder, []).append(key)
        draft, fs = self._fs(f"{self.path}/manifest/.{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(json.dumps({"buckets": self.buckets, "heavy": self.heavy, "tables": tables}).encode())
        out.close()
        jvm = self.spark._jvm.org.apache.hadoop.fs
        options = self.spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
        options[0] = jvm.Options.Rename.NONE
        place = jvm.Path(f"{self.path}/manifest/{self.version + 1:012d}.json")
        try:
            jvm.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, place, options)
        except Exception as e:
            fs.delete(draft, False)
            raise RuntimeError(f"another batch was written to {self.path} meanwhile; apply this one again") from e
        self.version += 1
        self.manifest = manifest

    def vacuum(self) -> None:
        """Deletes what the newest version doesn't use. Not while other objects read older versions or write."""
        self.refresh()
        for t in _TABLES:
            used = set(self.manifest[t].values())
            p, fs = self._fs(f"{self.path}/{t}")
            for x in fs.listStatus(p) if fs.exists(p) else []:
                if x.getPath().getName() not in used:
                    fs.delete(x.getPath(), True)

    def table(self, name: str, periods: list[str] | None = None, buckets: set[tuple[str, int]] | None = None) -> DataFrame:
        """Current rows, of the given periods or (period, bucket) only."""
        keys = [k for k in self.manifest[name] if (periods is None or k[0] in periods) and (buckets is None or k in buckets)]
        schema = T.StructType.fromDDL(_TABLES[name])
        if not keys:
            return self.spark.createDataFrame([], schema)
        folders: dict[str, list[tuple[str, int]]] = {}
        for k in keys:
            folders.setdefault(self.manifest[name][k], []).append(k)
        out = None
        for folder, own in folders.items():
            root = f"{self.path}/{name}/{folder}"
            df = self.spark.read.schema(schema).option("basePath", root).parquet(*[f"{root}/period={p}/bucket={b}" for p, b in own])
            out = df if out is None else out.unionByName(df)
        return out

    def _write(self, name: str, rows: DataFrame, manifest: dict) -> None:
        folder = f"v{self.version + 1}-{uuid.uuid4().hex[:12]}"
        root = f"{self.path}/{name}/{folder}"
        rows.select(*T.StructType.fromDDL(_TABLES[name]).fieldNames()).hint("rebalance", "period", "bucket").write.partitionBy("period", "bucket").parquet(root)
        glob, fs = self._fs(f"{root}/period=*/bucket=*")
        for x in fs.globStatus(glob):
            p = x.getPath()
            manifest[name][p.getParent().getName()[len("period=") :], int(p.getName()[len("bucket=") :])] = folder

    def _bucket(self, *cols: str) -> Column:
        return F.pmod(F.hash(*cols), F.lit(self.buckets)).cast("int")

    def _merge_counts(self, name: str, keys: list[str], deltas: DataFrame, manifest: dict) -> None:
        """Adds signed deltas to the buckets they fall into; counts that reach 0 go."""
        hit: set[tuple[str, int]] = set()
        if self.manifest[name]:
            hit = {(r[0], r[1]) for r in deltas.select("period", "bucket").distinct().collect()} & set(self.manifest[name])
        merged = deltas
        if hit:
            merged = self.table(name, buckets=hit).unionByName(deltas).groupBy("period", "bucket", *keys).agg(F.sum("n").alias("n"))
        for k in hit:
            del manifest[name][k]
        self._write(name, merged.filter("n > 0"), manifest)

    def apply(self, changes: DataFrame) -> list[str]:
        """Takes in a batch: rows period, basket, item, op, where op is 1 (the item is put into the basket) or -1 (taken out). Returns the periods that changed.

        Ops on the same item of a basket add up, and their sign counts; putting in what is there, or taking out what isn't, changes nothing. Rows with a null
        are left out, further columns ignored. period must be usable as a folder name. The batch counts as a whole or, if it fails, not at all.
        """
        self.refresh()
        manifest = {t: dict(keys) for t, keys in self.manifest.items()}
        ops = (
            changes.select("period", "basket", "item", "op").dropna().groupBy("period", "basket", "item").agg(F.sum("op").alias("op")).filter("op != 0")
        )
        old = None
        if self.manifest["baskets"]:
            ops = materialize(ops, "pair-changes")
            periods = [r[0] for r in ops.select("period").distinct().collect()]
            old = self.table("baskets", periods=periods).join(ops.select("period", "basket").distinct(), ["period", "basket"], "left_semi").select("period", "basket", "item", F.lit(True).alias("was"))
            members = ops.join(old, ["period", "basket", "item"], "full").select(
                "period", "basket", "item", F.coalesce("was", F.lit(False)).alias("was"), F.coalesce(F.col("op") > 0, F.col("was"), F.lit(False)).alias("now")
            )
        else:
            members = ops.filter("op > 0").select("period", "basket", "item", F.lit(False).alias("was"), F.lit(True).alias("now"))
        members = materialize(members.filter("was or now"), "members")
        size = lambda c: F.sum(F.col(c).cast("int"))
        sizes = members.groupBy("period", "basket").agg(size("was").alias("n_was"), size("now").alias("n_now"), F.max(F.col("was") != F.col("now")).alias("changed"))
        sizes = sizes.filter("changed").drop("changed")
        touched = members.join(sizes, ["period", "basket"])
        # A light basket has at most ``heavy`` items before and after, so the list is bounded by twice that.
        h = F.lit(self.heavy)
        light = touched.select(
            "period", "basket", "item", (F.col("was") & (F.col("n_was") <= h)).alias("was"), (F.col("now") & (F.col("n_now") <= h)).alias("now")
        ).filter("was or now")
        listed = light.groupBy("period", "basket").agg(F.sort_array(F.collect_list(F.struct("item", "was", "now"))).alias("m")).filter("size(m) > 1")
        pair_deltas = (
            listed.select("period", F.explode(_pairs_of("m")).alias("p")).groupBy("period", "p.item_a", "p.item_b").agg(F.sum("p.delta").cast("bigint").alias("n")).filter("n != 0")
        )
        item_deltas = touched.groupBy("period", "item").agg(F.sum(F.col("now").cast("int") - F.col("was").cast("int")).cast("bigint").alias("n")).filter("n != 0")
        period_deltas = sizes.groupBy("period").agg(F.sum((F.col("n_now") > 0).cast("int") - (F.col("n_was") > 0).cast("int")).cast("bigint").alias("n"))
        if old is not None:  # read again when the counts merge
            pair_deltas = materialize(pair_deltas, "pair-deltas")
        self._merge_counts("pairs", ["item_a", "item_b"], pair_deltas.withColumn("bucket", self._bucket("item_a", "item_b")), manifest)
        self._merge_counts("items", ["item"], item_deltas.withColumn("bucket", self._bucket("item")), manifest)
        self._merge_counts("periods", [], period_deltas.withColumn("bucket", F.lit(0)), manifest)
        for name, kept in (("baskets", touched.filter("now")), ("heavy", touched.filter(F.col("now") & (F.col("n_now") > h)))):
            rows = kept.select("basket", "item", "period", self._bucket("basket").alias("bucket"))
            if old is not None:
                hit = {(r[0], r[1]) for r in sizes.select("period", self._bucket("basket")).distinct().collect()} & set(self.manifest[name])
                if hit:
                    rows = self.table(name, buckets=hit).join(sizes.select("period", "basket"), ["period", "basket"], "left_anti").unionByName(rows)
                    for k in hit:
                        del manifest[name][k]
            self._write(name, rows, manifest)
        changed = [r[0] for r in period_deltas.select("period").distinct().collect()]
        self._commit(manifest)
        return changed

    def scores(self, periods: list[str] | None = None, min_count: int = 1, min_lift: int = 0) -> DataFrame:
        """period, item_a, item_b (item_a < item_b), baskets, n_a, n_b, n_ab and lift = n_ab * baskets / (n_a * n_b) of all pairs with n_ab >= min_count and lift >= min_lift.

        Exact for any setting. Bounds on count and lift only keep pairs that can't pass from being looked up.
        """
        if min_count < 1:
            raise ValueError("min_count must be positive")
        items = self.table("items", periods).drop("bucket")
        total = self.table("periods", periods).select("period", F.col("n").alias("baskets"))
        heavy = self.table("heavy", periods).drop("bucket")
        has_heavy = any(periods is None or k[0] in periods for k in self.manifest["heavy"])
        light = self.table("pairs", periods).select("period", "item_a", "item_b", F.col("n").alias("n_light"))
        big = lambda c: F.col(c).cast("decimal(19,0)")
        passes = lambda ab, a, b: (F.col(ab) >= min_count) & (big(ab) * big("baskets") >= F.lit(min_lift).cast("decimal(9,0)") * (F.col(a).cast("decimal(14,0)") * F.col(b).cast("decimal(14,0)")))
        if not has_heavy:
            light = light.filter(F.col("n_light") >= min_count)
            info = items.withColumn("h", F.lit(0).cast("bigint"))
        else:
            in_heavy = materialize(heavy.groupBy("period", "item").agg(F.count(F.lit(1)).alias("h")), "heavy-counts")
            # periods has one row per period, so it may be broadcast.
            info = materialize(items.join(in_heavy, ["period", "item"], "left").fillna(0, ["h"]).join(F.broadcast(total), "period"), "item-info")
            light = light.unionByName(self._heavy_pairs(heavy, info, min_count, passes)).groupBy("period", "item_a", "item_b").agg(F.sum("n_light").alias("n_light"))
        side = lambda x: info.select("period", F.col("item").alias(f"item_{x}"), F.col("n").alias(f"n_{x}"), F.col("h").alias(f"h_{x}"))
        known = light.join(side("a"), ["period", "item_a"]).join(side("b"), ["period", "item_b"]).join(F.broadcast(total), "period")
        known = known.withColumn("n_most", F.col("n_light") + F.least("h_a", "h_b")).filter(passes("n_most", "n_a", "n_b"))
        if has_heavy:
            known = materialize(known, "pair-candidates")
            # The item in fewer heavy baskets leads and is looked up in chunks of BLOCK baskets, so an item that is in very many of them only answers, by (item, basket), and
            # no task gets a whole list.
            a_leads = F.col("h_a") <= F.col("h_b")
            open_ = known.filter("h_a > 0 and h_b > 0").select(
                "period", "item_a", "item_b", F.when(a_leads, F.col("item_a")).otherwise(F.col("item_b")).alias("lead"), F.when(a_leads, F.col("item_b")).otherwise(F.col("item_a")).alias("other"),
                F.explode(F.sequence(F.lit(0), F.ceil(F.least("h_a", "h_b") / F.lit(BLOCK)).cast("int") - 1)).alias("chunk"),
            )
            listed = heavy.join(in_heavy, ["period", "item"])
            chunks = listed.select("period", F.col("item").alias("lead"), F.pmod(F.xxhash64("basket"), F.ceil(F.col("h") / F.lit(BLOCK))).cast("int").alias("chunk"), "basket")
            met = open_.join(chunks, ["period", "lead", "chunk"]).select("period", "item_a", "item_b", F.col("other").alias("item"), "basket")
            shared = met.join(heavy, ["period", "item", "basket"], "left_semi").groupBy("period", "item_a", "item_b").agg(F.count(F.lit(1)).alias("n_heavy"))
            known = known.join(shared, ["period", "item_a", "item_b"], "left").withColumn("n_ab", F.col("n_light") + F.coalesce("n_heavy", F.lit(0)))
        else:
            known = known.withColumn("n_ab", F.col("n_light"))
        return known.filter(passes("n_ab", "n_a", "n_b")).select(
            "period", "item_a", "item_b", "baskets", "n_a", "n_b", "n_ab", (F.col("n_ab").cast("double") * F.col("baskets") / (F.col("n_a").cast("double") * F.col("n_b"))).alias("lift")
        )

    def _heavy_pairs(self, heavy: DataFrame, info: DataFrame, min_count: int, passes) -> DataFrame:
        """Pairs that may share min_count heavy baskets and pass, with n_light 0: the prefixes of their basket lists meet, in blocks of bounded size."""
        sizes = heavy.groupBy("period", "basket").agg(F.count(F.lit(1)).alias("size"))
        listed = heavy.join(info.filter(F.col("h") >= min_count), ["period", "item"]).join(sizes, ["period", "basket"])
        if min_count > 1:
            # All but the first |H| - min_count + 1 are the last min_count - 1, and so few of an item are found within each task first. Large baskets last makes the lists that
            # meet short.
            place = F.row_number().over(Window.partitionBy("period", "item").orderBy(F.desc("size"), F.desc("basket")))
            listed = materialize(listed, "heavy-lists")
            last = listed.select("period", "item", "basket", "size").withColumn("place", place).filter(F.col("place") <= min_count - 1).select("period", "item", "basket")
            listed = listed.join(last, ["period", "item", "basket"], "left_anti")
        prefix = listed.select("period", "basket", "item", "n", "h", "baskets")
        prefix = materialize(prefix, "heavy-prefixes")
        blocks = prefix.groupBy("period", "basket").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
        cut = prefix.join(blocks, ["period", "basket"])
        left = cut.select("period", "basket", F.col("item").alias("item_a"), F.col("n").alias("n_a"), F.col("h").alias("h_a"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        right = cut.select("period", "basket", F.col("item").alias("item_b"), F.col("n").alias("n_b"), F.col("h").alias("h_b"), "baskets", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int").alias("block"))
        met = left.join(right, ["period", "basket", "block"]).filter(F.col("item_a") < F.col("item_b")).withColumn("n_most", F.least("h_a", "h_b", "n_a", "n_b"))
        # A pair with light baskets besides is in the light table anyway; here its heavy ones alone must do.
        return met.filter(passes("n_most", "n_a", "n_b")).select("period", "item_a", "item_b").distinct().withColumn("n_light", F.lit(0).cast("bigint"))
