"""The N best items of every group by descending score bands.

Bands are ranges of the score between its upper quantiles, whatever numbers the scores are, and items are stored by band. Bands are worked off from the top: items of groups that
are filled drop out by an anti-join before anything is ranked, and the others are ranked exactly within the band, ties by item, as far as their group has room. How many items a
group has so far is carried from band to band. Ranking starts within each task, where at most N items of a group go on, so a group with millions of items, or a
third of all rows, costs one task no more than its share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import materialize

#: Shares of the items below the bands' borders.
QUANTILES = (0.5, 0.75, 0.875, 0.9375, 0.97, 0.985)


def band_borders(scores: DataFrame, score: str, quantiles: tuple[float, ...] = QUANTILES) -> list[float]:
    """Different scores at the quantiles, ascending; a band begins at each, and the lowest holds all below the first."""
    found = scores.agg(F.percentile_approx(F.col(f"`{score}`").cast("double"), F.array(*map(F.lit, quantiles)), 2000)).first()[0]
    return sorted(set(found or []))


def top_n(scores: DataFrame, groups: list[str], item: str, score: str, n: int) -> DataFrame:
    """groups, item, score and rank of the up to n items with the highest score in each group; equal scores are ordered by item ascending.

    scores: one row per group and item; of repeated rows of an item each counts. Rows with a null group column, item or score, or with NaN, are left out; scores
    may be any numbers, infinite ones too; an empty table or n = 0 gives no rows. Columns of other names are ignored.
    """
    if n < 0:
        raise ValueError("n must not be negative")
    names = {g: f"_g{i}" for i, g in enumerate(groups)}
    keys = list(names.values())
    s = F.col(f"`{score}`")
    flat = scores.select(*[F.col(f"`{g}`").alias(k) for g, k in names.items()], F.col(f"`{item}`").alias("_item"), s.alias("_score")).dropna()
    flat = materialize(flat, "scores")
    borders = band_borders(flat, "_score") if n else []
    band = F.lit(0)
    for k, low in enumerate(borders, 1):
        band = F.when(F.col("_score").cast("double") >= low, F.lit(k)).otherwise(band)
    stored = materialize(flat.withColumn("_band", band), "bands", ("_band",))
    order = [F.desc("_score"), F.asc("_item")]
    done: DataFrame | None = None
    taken: DataFrame | None = None
    for b in range(len(borders), -1, -1):
        items = stored.filter(F.col("_band") == b).drop("_band")
        if taken is not None:
            items = items.join(taken.filter(F.col("_taken") >= n).select(*keys), keys, "left_anti")
        ranked = items.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rank") <= n)
        if taken is not None:
            ranked = ranked.join(taken, keys, "left").withColumn("_rank", F.col("_rank") + F.coalesce("_taken", F.lit(0))).filter(F.col("_rank") <= n)
        chosen = materialize(ranked.select(*keys, "_item", "_score", F.col("_rank").cast("int").alias("_rank")), f"band-{b}")
        done = chosen if done is None else done.unionByName(chosen)
        if b:
            counts = chosen.groupBy(*keys).agg(F.max("_rank").alias("_taken"))
            taken = materialize(counts if taken is None else taken.unionByName(counts).groupBy(*keys).agg(F.max("_taken").alias("_taken")), "taken")
    return done.select(*[F.col(k).alias(g) for g, k in names.items()], F.col("_item").alias(item), F.col("_score").alias(score), F.col("_rank").alias("rank"))
