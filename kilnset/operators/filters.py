"""Subset, relabel and integrity predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnset.operators.small import join_small

from kilnset.operators.ranking import positions


def relabel(df: DataFrame, target: str, classes: list) -> DataFrame:
    """Keep the listed classes; the new label is the place in the list."""
    dtype = df.schema[target].dataType.simpleString()
    table = df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(classes)], f"{target} {dtype}, new_label int")
    return join_small(df, table, target)


def map_samples(df: DataFrame, sample: str, target: str, transform=None, target_transform=None) -> DataFrame:
    """Apply the user's column functions to sample and target."""
    out = df
    if transform is not None:
        out = out.withColumn(sample, transform(F.col(sample)))
    if target_transform is not None:
        out = out.withColumn(target, target_transform(F.col(target)))
    return out


def has_extension(path: Column, *extensions: str) -> Column:
    """Case-insensitive file extension predicate."""
    ends = "|".join(e.lstrip(".") for e in extensions)
    return F.lower(path).rlike(rf"\.({ends})$")


def integrity(df: DataFrame, key: str, content: Column, manifest: DataFrame, digest: str) -> DataFrame:
    """md5 of each record against a manifest: ok, mismatch or missing."""
    actual = df.select(key, F.md5(content).alias("actual"))
    status = (
        F.when(F.col(digest).isNull(), F.lit("missing"))
        .when(F.col("actual") == F.col(digest), F.lit("ok")).otherwise(F.lit("mismatch"))
    )
    return actual.join(manifest.select(key, digest), key, "left").select(key, "actual", status.alias("status"))


def stage_output(df: DataFrame, stages: list[tuple[str, Column]], wanted: list[str], keep: list[str]) -> DataFrame:
    """Only the wanted stages' columns; the optimiser prunes the others."""
    out = df
    for name, expr in stages:
        out = out.withColumn(name, expr)
    return out.select(*keep, *wanted)


def iteration_window(df: DataFrame, rank: str, order: list[str], warm_up: int, cap: int, tail: int) -> DataFrame:
    """Iterations warm_up .. cap - tail of every rank, numbered from 0."""
    steps = positions(df, order, [rank], name="step")
    return steps.where((F.col("step") >= warm_up) & (F.col("step") < cap - tail))


def nan_report(df: DataFrame, groups: list[str], metric: str, fail: bool = False) -> DataFrame:
    """NaN count per group; with ``fail`` a NaN ends the job."""
    bad = F.sum(F.when(F.isnan(metric), 1).otherwise(0))
    if fail:
        bad = F.when(bad > 0, F.raise_error(F.lit(f"{metric} is NaN")).cast("bigint")).otherwise(bad)
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), bad.alias("n_nan"))
