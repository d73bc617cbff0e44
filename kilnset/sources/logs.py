"""Telemetry sources: stage trace lines and utilisation CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Stage names of a trace line, in line order.
TRACE_STAGES = ["GET_tar", "GET_img", "FETCH", "DECODE", "LOAD", "AUG"]
UTILISATION_SCHEMA = "time string, gpu_id int, gpu_utilization double, memory_usage double, cpu_usage double, rest string"


def parse_trace(lines: DataFrame, value: str = "value") -> DataFrame:
    """Trace lines -> (gpu, sample index, stage, seconds); stages a line does
    not name are left out."""
    text = F.col(value)
    seconds = [F.regexp_extract(text, rf"{s}\t([0-9.eE+-]+)", 1) for s in TRACE_STAGES]
    pairs = F.array(*[
        F.struct(F.lit(s).alias("stage"), F.when(c != "", c).cast("double").alias("seconds"))
        for s, c in zip(TRACE_STAGES, seconds)])
    rows = lines.select(
        F.regexp_extract(text, r"GPU: (\d+)", 1).cast("int").alias("gpu"),
        F.regexp_extract(text, r"INDEX\t(\d+)", 1).cast("bigint").alias("index"), F.explode(pairs).alias("p"))
    return rows.select("gpu", "index", "p.stage", "p.seconds").where(F.col("seconds").isNotNull())


def read_utilisation(spark, path: str, stream: bool = False) -> DataFrame:
    """Utilisation CSV; its lines end in a comma, hence a sixth empty column."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(UTILISATION_SCHEMA).option("header", True).csv(path).drop("rest")


def parse_utilisation(lines: DataFrame, value: str = "value") -> DataFrame:
    """The same CSV lines when they arrive as text."""
    row = F.from_csv(F.col(value), UTILISATION_SCHEMA)
    return lines.select(row.alias("r")).select("r.*").drop("rest")
