"""Meters, accumulators and running values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnset.operators.ranking import linear_recurrence, positions, running


def average_meter(df: DataFrame, value: Column, weight: Column, order: str, groups: list[str] = ()) -> DataFrame:
    """Last value, weighted sum, count and average."""
    return df.groupBy(*groups).agg(
        F.max_by(value, order).alias("val"), F.sum(value * weight).alias("sum"), F.sum(weight).alias("count"),
        (F.sum(value * weight) / F.sum(weight)).alias("avg"))


def accumulate(df: DataFrame, values: str, divide_by: str | float | None = None, groups: list[str] = ()) -> DataFrame:
    """Sum dictionaries (map column) key by key; divide by one key, which
    itself stays a sum, or by a number."""
    sums = df.select(*groups, F.explode(values).alias("key", "v")).groupBy(*groups, "key").agg(F.sum("v").alias("total"))
    if divide_by is None:
        return sums.withColumn("value", F.col("total"))
    if isinstance(divide_by, (int, float)):
        return sums.withColumn("value", F.col("total") / divide_by)
    base = sums.where(F.col("key") == divide_by).select(*groups, F.col("total").alias("__base"))
    joined = sums.join(base, list(groups)) if groups else sums.withColumn("__base", base.select("__base").scalar())
    return joined.withColumn(
        "value", F.when(F.col("key") == divide_by, F.col("total")).otherwise(F.col("total") / F.col("__base"))
    ).drop("__base")


def running_average(df: DataFrame, value: Column, weight: Column, order: list[str], groups: list[str]) -> DataFrame:
    """Average shown after each update, null while nothing has weight."""
    out = running(df, {"run_sum": ("sum", value * weight), "run_count": ("sum", weight)}, order, groups)
    return out.withColumn("run_avg", F.try_divide(F.col("run_sum").cast("double"), F.col("run_count")))


def iteration_times(df: DataFrame, micros: Column, order: list[str], groups: list[str]) -> DataFrame:
    """Microseconds since the previous row of the group."""
    out = running(df.withColumn("__at", micros), {"__before": ("previous", F.col("__at"))}, order, groups)
    return out.withColumn("iter_us", F.col("__at") - F.col("__before")).drop("__at", "__before")


def loss_ema(df: DataFrame, value: Column, order: list[str], groups: list[str], keep: float = 0.9) -> DataFrame:
    """``keep * ema + (1 - keep) * x``, seeded with the first value."""
    first = F.col("pos") == 0
    return linear_recurrence(
        df, F.when(first, 0.0).otherwise(keep), F.when(first, value).otherwise(value * (1 - keep)), order, groups, "ema")


def warmup_ema(df: DataFrame, value: Column, order: list[str], groups: list[str], mu: float) -> DataFrame:
    """Decay ``min(mu, (1 + step) / (10 + step))``, first value copied."""
    first = F.col("pos") == 0
    decay = F.least(F.lit(mu), (F.lit(1.0) + F.col("pos")) / (F.lit(10.0) + F.col("pos")))
    return linear_recurrence(
        df, F.when(first, 0.0).otherwise(decay), F.when(first, value).otherwise(value * (1 - decay)), order, groups, "ema")


def best_so_far(df: DataFrame, value: Column, order: list[str], groups: list[str]) -> DataFrame:
    return running(df, {"best": ("max", value)}, order, groups)


def percentiles(df: DataFrame, value: str, key: str, groups: list[str], qs: list[float]) -> DataFrame:
    """Exact interpolated percentiles by position: no value list per group."""
    ranked = positions(df.select(*groups, value, key), [value, key], groups, total="n")
    out = []
    for i, q in enumerate(qs):
        at = (F.col("n") - 1) * F.lit(q)
        low, high = F.floor(at), F.ceil(at)
        share = F.when(F.col("pos") == low, F.lit(1.0) - (at - low)).when(F.col("pos") == high, at - low)
        out.append(F.sum(F.when((F.col("pos") == low) | (F.col("pos") == high), F.col(value) * share)).alias(
            f"p{round(q * 100)}"))
    return ranked.groupBy(*groups).agg(*out)
