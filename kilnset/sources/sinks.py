"""Sinks: partitioned results and epoch shards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_results(df: DataFrame, path: str, keys: list[str], rows_per_file: int = 1 << 20) -> None:
    """Results by experiment key; only the partitions present are replaced.
    Rows are brought together by key, so a small key is one file, and a key with
    many rows is spread over as many tasks as it needs files."""
    files = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / rows_per_file).alias("__files"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    spread = df.alias("a").join(files.alias("b"), same).select("a.*", "__files")
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind])
    spread = spread.withColumn("__file", F.pmod(hashed, F.col("__files")))
    (
        spread.repartition(*keys, "__file").drop("__files", "__file")
        .write.partitionBy(*keys).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    )


def write_epoch(df: DataFrame, path: str, batches_per_file: int = 256) -> None:
    """Training-ready shards by (epoch, rank), each file made of runs of
    batches in (batch, position) order. The number of runs grows with the
    data, so a rank is written by many tasks."""
    spread = df.withColumn("__file", F.floor(F.col("batch_id") / batches_per_file))
    (
        spread.repartition("epoch", "rank", "__file").drop("__file")
        .sortWithinPartitions("epoch", "rank", "batch_id", "pos_in_batch")
        .write.partitionBy("epoch", "rank").mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").parquet(path)
    )
