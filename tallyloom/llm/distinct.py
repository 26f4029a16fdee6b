"""Distinct counts over huge identifier sets by linear counting on fixed bitmaps.

Every group has a bitmap of the same fixed number of bits. An identifier sets the bit its hash names, partial results merge by bitwise union, and the share of
empty bits gives the cardinality: n = -m ln(empty / m). A bitmap is stored as rows (group, word number, 64-bit word) without its empty words, so a group with ten
identifiers costs at most ten rows, a full one m / 64, no group's bitmap is ever in one row or task, and union is a hash aggregate with map-side combination.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 64
WORD_NO, WORD_BITS = "word_no", "word_bits"


def relative_error(n: float, bits: int) -> float:
    """Standard error of the estimate relative to n (Whang et al. 1990)."""
    t = n / bits
    if t > 700:
        return math.inf
    return math.sqrt(bits * (math.exp(t) - t - 1)) / n if n else 0.0


def bitmap_bits(most: int, error: float, sigmas: float = 3.0) -> int:
    """The least power of two of bits, 64 at least, with which ``sigmas`` standard errors stay within ``error`` for every cardinality up to ``most``."""
    if most < 1 or not 0 < error < 1:
        raise ValueError("most must be positive and error between 0 and 1")
    bits = WORD
    # The relative error grows with n, so the largest cardinality decides; at small n it is 1 / sqrt(2 bits).
    while sigmas * max(relative_error(most, bits), 1 / math.sqrt(2 * bits)) > error or bits < most / 12:
        bits *= 2
    return bits


def sized_bits(rows: DataFrame, identifier: str, error: float, sigmas: float = 3.0) -> int:
    """Bits with which no group of the rows, nor all of them together, has an error above ``error``: sized for a fifth more identifiers than a first count, itself within 2 % as a
    rule, finds. A bitmap is stored without its empty words, so small groups don't pay for the size that all rows together need."""
    found = rows.agg(F.approx_count_distinct(F.col(f"`{identifier}`"), 0.02)).first()[0] or 0
    return bitmap_bits(max(100, math.ceil(1.2 * found)), error, sigmas)


def fast_hash(c: Column) -> Column:
    return F.xxhash64(c)


def bitmaps(rows: DataFrame, groups: list[str], identifier: str, bits: int, hash_with=fast_hash) -> DataFrame:
    """Stored partial results: groups, word_no, word_bits. Rows with a null identifier set no bit; a null in a group column is a group of its own; groups without identifiers have no row."""
    if bits < WORD or bits & (bits - 1):
        raise ValueError(f"bits must be a power of two, {WORD} at least")
    place = F.pmod(hash_with(F.col(f"`{identifier}`").cast("string")), F.lit(bits).cast("bigint"))
    return (
        rows.filter(F.col(f"`{identifier}`").isNotNull())
        .select(*[F.col(f"`{g}`") for g in groups], place.alias("_place"))
        .groupBy(*[f"`{g}`" for g in groups], F.shiftright("_place", 6).alias(WORD_NO))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("_place", F.lit(WORD)).cast("int"))).alias(WORD_BITS))
    )


def merge(partials: DataFrame, groups: list[str]) -> DataFrame:
    """Partial results of coarser groups, by union of bitmaps of equal size. Merging is associative and idempotent, so overlapping partials do no harm."""
    return partials.groupBy(*[f"`{g}`" for g in groups], WORD_NO).agg(F.bit_or(WORD_BITS).alias(WORD_BITS))


def estimate(partials: DataFrame, groups: list[str], bits: int, sigmas: float = 3.0) -> DataFrame:
    """groups, bits_set, estimate, error_bound (``sigmas`` standard errors, absolute) of merged partial results, one row per group and word. A full bitmap has a null estimate and bound: it was sized too small."""
    m = float(bits)
    ones = F.col("bits_set")
    n = F.when(ones < bits, -F.lit(m) * F.log((F.lit(m) - ones) / F.lit(m)))
    t = F.col("estimate") / F.lit(m)
    return (
        partials.groupBy(*[f"`{g}`" for g in groups])
        .agg(F.sum(F.bit_count(WORD_BITS)).cast("bigint").alias("bits_set"))
        .withColumn("estimate", n)
        .withColumn("error_bound", F.when(F.col("estimate").isNotNull(), F.lit(sigmas) * F.sqrt(F.greatest(F.lit(0.0), F.lit(m) * (F.exp(t) - t - F.lit(1.0))))))
    )


def cube_estimates(partials: DataFrame, groups: list[str], bits: int, sigmas: float = 3.0) -> DataFrame:
    """Estimates of every combination of the group columns, null where a column is merged away; ``level`` names the columns kept.

    Each level is merged from the finest level above it that has already been reduced, not from the rows.
    """
    levels = {tuple(groups): partials}
    order = sorted((tuple(g for i, g in enumerate(groups) if mask >> i & 1) for mask in range(2 ** len(groups))), key=lambda k: (-len(k), k))
    out = None
    kinds = dict(partials.dtypes)
    for kept in order:
        if kept not in levels:
            parent = next(p for p in sorted(levels, key=len) if set(kept) < set(p) and len(p) == len(kept) + 1)
            levels[kept] = merge(levels[parent], list(kept))
        found = estimate(levels[kept], list(kept), bits, sigmas)
        if not kept:
            found = found.filter("bits_set is not null")
        part = found.select(
            F.lit("+".join(kept)).alias("level"), *[F.col(f"`{g}`") if g in kept else F.lit(None).cast(kinds[g]).alias(g) for g in groups], "bits_set", "estimate", "error_bound"
        )
        out = part if out is None else out.unionByName(part)
    return out
