"""Splits, stratified quotas and worker shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnset.functions.hashing import uniform
from kilnset.operators.ranking import positions
from kilnset.operators.sampling import permutation
from kilnset.operators.small import join_small
from kilnset.session import checkpoint


def random_split(df: DataFrame, key: str, lengths: list[int], seed: int) -> DataFrame:
    """Column ``split``: index of the part; lengths must add up to the rows."""
    ranked = permutation(df, key, seed, total="__n")
    bound, part = 0, F.lit(None).cast("int")
    for i, size in reversed(list(enumerate(lengths))):
        bound = sum(lengths[: i + 1])
        part = F.when(F.col("pos") < bound, F.lit(i)).otherwise(part)
    wrong = F.raise_error(F.lit("lengths do not add up to the number of rows")).cast("int")
    split = F.when(F.col("__n") != sum(lengths), wrong).otherwise(part)
    return ranked.withColumn("split", split).drop("__n")


def class_quota(df: DataFrame, target: str, size: Column) -> DataFrame:
    """Rows per class so that they add up to ``size``: floor of the exact
    share, the rest by largest remainder (ties: smaller class first).
    ``size`` may use ``n``, the number of rows."""
    # one row per class, kept because ranking reads it several times
    counts = checkpoint(df.groupBy(target).agg(F.count(F.lit(1)).alias("n_class")))
    total = counts.agg(F.sum("n_class").alias("n"))
    shares = (
        counts.withColumn("n", total.scalar())
        .withColumn("size", size.cast("bigint"))
        .withColumn("base", F.floor(F.col("n_class") * F.col("size") / F.col("n")).cast("bigint"))
        .withColumn("rest", -((F.col("n_class") * F.col("size")) % F.col("n")))
    )
    ranked = positions(shares, ["rest", target], name="place")
    spare = shares.agg((F.first("size") - F.sum("base")).alias("spare"))
    return ranked.withColumn("spare", spare.scalar()).select(
        target, "n_class", (F.col("base") + F.when(F.col("place") < F.col("spare"), 1).otherwise(0)).alias("quota")
    )


def stratified_shuffle_split(
    df: DataFrame, key: str, target: str, valid_size: Column, seed: int, draws: int = 1
) -> DataFrame:
    """Independent stratified draws: ``split_idx`` in 0..draws-1 and
    ``is_valid``. Only the (class, quota) table is joined; a hot class is
    ranked in slices of the hash."""
    quota = checkpoint(class_quota(df, target, valid_size).select(target, "quota"))  # counted before it is joined
    copies = df.withColumn("split_idx", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    copies = copies.withColumn("__u", uniform("strat", seed, F.col("split_idx"), key))
    ranked = positions(copies, ["__u", key], ["split_idx", target], uniform="__u").drop("__u")
    return join_small(ranked, quota, target).withColumn("is_valid", F.col("pos") < F.col("quota")).drop("quota", "pos")


def reduce_stratified(df: DataFrame, key: str, target: str, size: int, seed: int) -> DataFrame:
    """Keep exactly ``size`` rows with the class shares of the whole."""
    return (
        stratified_shuffle_split(df, key, target, F.lit(size), seed)
        .where("is_valid").drop("split_idx", "is_valid")
    )


def worker_shards(df: DataFrame, key: str, workers: int) -> DataFrame:
    """Contiguous shards of ceil(n / workers); trailing shards may be empty."""
    ranked = positions(df, [key], total="__n")
    per_worker = F.ceil(F.col("__n") / F.lit(max(workers, 1)))
    return ranked.withColumn("worker", F.floor(F.col("pos") / per_worker)).drop("__n")


def even_parts(df: DataFrame, order: list[str], parts: int, groups=()) -> DataFrame:
    """Contiguous parts whose sizes differ by at most one, longer parts first."""
    ranked = positions(df, order, groups, total="__n")
    k = F.lit(parts)
    q, r, pos = F.floor(F.col("__n") / k), F.col("__n") % k, F.col("pos")
    head = r * (q + 1)
    part = F.when(pos < head, F.floor(pos / (q + 1))).otherwise(r + F.floor((pos - head) / F.greatest(q, F.lit(1))))
    return ranked.withColumn("part", part.cast("bigint")).drop("__n")


def overlap_report(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Counts of keys shared by and exclusive to the left side."""
    shared = left.join(right, key, "left_semi").select(F.lit("shared").alias("kind"))
    only = left.join(right, key, "left_anti").select(F.lit("left_only").alias("kind"))
    return shared.unionByName(only).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
