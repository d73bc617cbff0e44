"""Sharding: Feistel permutation with cycle walking over global row numbers.

Every row gets a number 0 .. N-1 that depends only on the rows' keys. A keyed
Feistel network permutes the smallest even-bit power of two above N, and values
that fall outside 0 .. N-1 are permuted again until they fall inside, which
keeps it a bijection on 0 .. N-1. The permuted number p gives the place without
any further shuffle: shard ``p mod S``, slot ``p div S``. Shard sizes differ by
one row at most, slots have no gaps, and ``locate`` / ``row_at`` compute place
and number from each other for one row alone.

Rows are moved one by one: equal texts are spread like any other rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kilnset.llm.words import mix

ROUNDS = 6
#: Hash ranges that are numbered on their own; the offsets are so many rows.
RANGES = 4096


def _half_bits(n: int) -> int:
    bits = max(2, (max(n, 1) - 1).bit_length())
    return (bits + 1) // 2


def _feistel(x: np.ndarray, half: int, seed: int, inverse: bool) -> np.ndarray:
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> shift, x & mask
    keys = [np.uint64((seed * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) % (1 << 64)) for r in range(ROUNDS)]
    if inverse:
        for key in reversed(keys):
            left, right = right ^ (mix(left ^ key) & mask), left
    else:
        for key in keys:
            left, right = right, left ^ (mix(right ^ key) & mask)
    return (left << shift) | right


def permute(numbers, n: int, seed: int = 0, inverse: bool = False) -> np.ndarray:
    """Bijection of 0 .. n-1 by cycle walking (int64 array in, int64 out)."""
    out = np.asarray(numbers).astype(np.uint64)
    half = _half_bits(n)
    out = _feistel(out, half, seed, inverse)
    outside = np.flatnonzero(out >= n)
    while len(outside):
        out[outside] = _feistel(out[outside], half, seed, inverse)
        outside = outside[out[outside] >= n]
    return out.astype(np.int64)


def locate(number: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of one row number."""
    p = int(permute([number], n, seed)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    """Row number that sits at a shard and slot."""
    return int(permute([slot * shards + shard], n, seed, inverse=True)[0])


def number_rows(df: DataFrame, name: str = "row_number", ranges: int = RANGES) -> DataFrame:
    """Add a number 0 .. N-1 that does not depend on partitioning.

    Equal rows are counted together before any shuffle, so repeated rows don't
    meet in one task; each hash range is numbered on its own and shifted by the
    rows of the ranges before it. Null values count as values.
    """
    cols = df.columns
    counted = df.groupBy(*[F.col(f"`{c}`") for c in cols]).agg(F.count(F.lit(1)).alias("__copies"))
    counted = counted.withColumn("__range", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in cols]), F.lit(ranges)))
    order = [F.col(f"`{c}`").asc_nulls_first() for c in cols]
    inside = Window.partitionBy("__range").orderBy(*order)
    upto = F.sum("__copies").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    totals = counted.groupBy("__range").agg(F.sum("__copies").alias("__n"))
    # at most ``ranges`` rows
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    rows = counted.withColumn("__upto", upto).join(F.broadcast(offsets), "__range")
    start = F.col("__offset") + F.col("__upto") - F.col("__copies")
    numbers = F.explode(F.sequence(start, start + F.col("__copies") - 1))
    return rows.select(*[F.col(f"`{c}`") for c in cols], numbers.alias(name))


def shard_rows(df: DataFrame, shards: int = 16, seed: int = 0, count: int | None = None) -> DataFrame:
    """All rows of ``df`` with ``row_number``, ``shard`` (int) and ``slot``.

    One row for each input row, all its columns kept (columns that can't be
    grouped, such as maps, must be left out or cast before). Nulls are values,
    repeated rows get places of their own, an empty table stays empty.
    """
    n = df.count() if count is None else count

    @F.pandas_udf("long")
    def place(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), n, seed))

    out = number_rows(df).withColumn("__p", place("row_number"))
    return out.withColumn("shard", (F.col("__p") % shards).cast("int")).withColumn(
        "slot", F.floor(F.col("__p") / shards).cast("long")).drop("__p")
