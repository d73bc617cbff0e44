"""Policy-search results: ranking, decoding and merging trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kilnset.functions.tensors import literal_array


#: Trials of one task: a decoded one takes some KB and 30 draws, and a file of a few
#: MB, which one task reads, holds a million.
ROWS_PER_TASK = 1 << 15


def spread(trials: DataFrame) -> DataFrame:
    """The rows dealt evenly to tasks of at most about ``ROWS_PER_TASK``, before
    columns that are wide or costly are added."""
    least = int(trials.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return trials.repartition(max(least, -(-trials.count() // ROWS_PER_TASK)))


def top_per_fold(trials: DataFrame, fold: str, reward: str, trial: str, n: int = 10) -> DataFrame:
    """Best n trials per fold. The rank limit is applied in every task before
    the shuffle, so a hot fold sends n rows per task."""
    w = Window.partitionBy(fold).orderBy(F.desc(reward), F.asc(trial))
    return trials.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def top_trials(trials: DataFrame, reward: str, trial: str, n: int) -> DataFrame:
    return trials.orderBy(F.desc(reward), F.asc(trial)).limit(n)


def decode_policies(trials: DataFrame, config: str, num_policy: int, num_op: int, op_names: list[str]) -> DataFrame:
    """Config map -> one row per (trial, policy) with its ordered ops."""

    def entry(kind, i, j):
        return F.element_at(config, F.concat_ws("_", F.lit(kind), i.cast("string"), j.cast("string")))

    names = literal_array(op_names)
    i = F.col("policy_id")
    ops = F.transform(
        F.sequence(F.lit(0), F.lit(num_op - 1)),
        lambda j: F.struct(
            F.get(names, entry("policy", i, j).cast("int")).alias("op"), entry("prob", i, j).alias("prob"),
            entry("level", i, j).alias("level")))
    return (
        trials.withColumn("policy_id", F.explode(F.sequence(F.lit(0), F.lit(num_policy - 1))))
        .withColumn("ops", ops).drop(config)
    )


def unique_policies(policies: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """First policy for every sequence of op names, levels ignored. ``min_by``
    combines before the shuffle, so popular sequences are not a hot spot."""
    keyed = policies.withColumn("op_key", F.array_join(F.transform("ops", lambda o: o["op"]), "_"))
    rest = [c for c in policies.columns if c not in scope]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return keyed.groupBy(*scope, "op_key").agg(first.alias("p")).select(*scope, "op_key", "p.*")


def gpu_hours(trials: DataFrame, elapsed: str) -> DataFrame:
    return trials.agg((F.sum(elapsed) / 3600).alias("gpu_hours"))


def mode_means(results: DataFrame, mode: str, metrics: list[str]) -> DataFrame:
    """Mean over repeated experiments per mode."""
    return results.groupBy(mode).agg(
        F.count(F.lit(1)).alias("experiments"), *[F.avg(m).alias(m) for m in metrics])
