"""Event-time windows over telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_rates(events: DataFrame, ts: str, stage: str, value: str, length: str, slide: str | None = None) -> DataFrame:
    """Rows, mean and maximum per stage and (sliding) window."""
    window = F.window(ts, length, slide) if slide else F.window(ts, length)
    return events.groupBy(window.alias("w"), F.col(stage)).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("high")
    ).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), stage, "n", "mean", "high")


def busy_sessions(events: DataFrame, ts: str, worker: str, gap: str) -> DataFrame:
    """Busy periods of a worker, ended by an idle gap."""
    return events.groupBy(F.session_window(ts, gap).alias("w"), F.col(worker)).agg(F.count(F.lit(1)).alias("n")).select(
        worker, F.col("w.start").cast("timestamp_ntz").alias("busy_from"), F.col("w.end").cast("timestamp_ntz").alias("idle_at"), "n")
