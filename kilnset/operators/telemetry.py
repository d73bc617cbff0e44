"""Throughput, stage latency and straggler reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnset.operators.meters import percentiles


def _rate(samples: Column, seconds: Column) -> Column:
    """Samples a second; infinite where no time has passed."""
    return F.when(seconds == 0, F.lit(float("inf"))).otherwise(samples / seconds)


def throughput(df: DataFrame, batch_size: int, seconds: str, groups: list[str]) -> DataFrame:
    """Mean of the per-iteration rates, and total samples over total time."""
    n = F.count(F.lit(1))
    return df.groupBy(*groups).agg(
        n.alias("iterations"), F.avg(_rate(F.lit(float(batch_size)), F.col(seconds))).alias("mean_rate"),
        _rate((n * batch_size).cast("double"), F.sum(seconds)).alias("overall_rate"))


def stage_latency(df: DataFrame, stage: str, seconds: str, key: str, qs: list[float]) -> DataFrame:
    """Count, mean, extremes and exact percentiles per stage."""
    basic = df.groupBy(stage).agg(
        F.count(F.lit(1)).alias("n"), F.avg(seconds).alias("mean"), F.min(seconds).alias("low"), F.max(seconds).alias("high"))
    return basic.join(percentiles(df, seconds, key, [stage], qs), stage)


def choose_pipeline(profiles: DataFrame, workload: str, pipeline: str, baseline: str) -> DataFrame:
    """Offload decision per workload from profile rows
    (workload, pipeline, cpu, train_rate, rate).

    Value of a candidate: ``L * (1 - O / P) + R``; the best one (first name on
    a tie) gets ratio ``R / G`` when ``(G - L) * (1 + O / P) < R`` and
    ``R / (L + R)`` otherwise.
    """
    means = profiles.groupBy(workload, pipeline).agg(
        F.avg("cpu").alias("cpu"), F.avg("train_rate").alias("train_rate"), F.avg("rate").alias("rate"))
    base = means.where(F.col(pipeline) == baseline).select(
        workload, F.col("cpu").alias("p"), F.col("train_rate").alias("g"), F.col("rate").alias("l"))
    cand = means.where(F.col(pipeline) != baseline).join(base, workload).select(
        workload, pipeline, F.col("cpu").alias("o"), F.col("rate").alias("r"), "p", "g", "l",
        (F.col("l") * (1 - F.col("cpu") / F.col("p")) + F.col("rate")).alias("value"))
    best = cand.groupBy(workload).agg(F.min_by(F.struct(pipeline, "o", "r", "p", "g", "l", "value"),
                                               F.struct(-F.col("value"), F.col(pipeline))).alias("b")).select(workload, "b.*")
    lower = (F.col("g") - F.col("l")) * (1 + F.col("o") / F.col("p"))
    ratio = F.when(lower < F.col("r"), F.col("r") / F.col("g")).otherwise(F.col("r") / (F.col("l") + F.col("r")))
    return best.select(workload, pipeline, "value", lower.alias("lower"), ratio.alias("offload_ratio"))


def stragglers(progress: DataFrame, node: str, rank: str, batch_no: str, left: str, finished: str, threshold: int) -> DataFrame:
    """Fast and slow ranks of every node: ahead of the slowest batch (or
    finished) is fast; at the slowest batch with enough work left is slow."""
    ends = progress.groupBy(node).agg(F.max(batch_no).alias("fastest"), F.min(batch_no).alias("slowest"))
    ahead = (F.col(batch_no) > F.col("slowest")) | F.col(finished)
    state = (
        F.when(F.col("slowest") == F.col("fastest"), F.lit("even"))
        .when(ahead, F.lit("fast")).when(F.col(left) >= threshold, F.lit("slow")).otherwise(F.lit("nearly_done")))
    return progress.join(ends, node).select(node, rank, batch_no, left, "fastest", "slowest", state.alias("state"))


def remaining_work(tasks: DataFrame, groups: list[str], sent: Column, done: Column) -> DataFrame:
    """Planned, sent and done tasks; left = unsent + queued."""
    n = F.count(F.lit(1))
    s = F.sum(F.when(sent, 1).otherwise(0))
    d = F.sum(F.when(done, 1).otherwise(0))
    return tasks.groupBy(*groups).agg(
        n.alias("planned"), s.alias("sent"), d.alias("done"), (n - s).alias("unsent"), (s - d).alias("queued"),
        (n - d).alias("left_tasks"))


def class_counts(df: DataFrame, target: str) -> DataFrame:
    return df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))


def class_cardinality(df: DataFrame, target: str, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct(target) if approximate else F.count_distinct(target)
    return df.agg(F.count(F.lit(1)).alias("samples"), distinct.alias("classes"))
