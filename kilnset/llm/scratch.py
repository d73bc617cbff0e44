"""Intermediate tables in the shared folder.

A written table cuts lineage: a lost executor costs the tasks that read it, not
the stages before it. Shuffle files behind a table go as soon as it is written,
and ``drop`` removes a table nobody needs any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnset.session import fresh_path

#: While a table is written: shuffle files go at its end, and Python gets texts
#: in batches of some megabytes.
WHILE_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
}


class Scratch:
    """Tables of one operator call; ``batch_bytes`` bounds what Python gets at once."""

    def __init__(self, spark: SparkSession, label: str, batch_bytes: int | None = None):
        self.spark = spark
        self.settings = dict(WHILE_WRITING)
        if batch_bytes:
            self.settings["spark.sql.execution.arrow.maxBytesPerBatch"] = str(batch_bytes)
        self.root = fresh_path(spark, label)
        self.made = 0

    def write(self, df: DataFrame) -> DataFrame:
        """``df`` as a table of the shared folder, read back."""
        self.made += 1
        path = f"{self.root}/{self.made}"
        before = {k: self.spark.conf.get(k) for k in self.settings}
        try:
            for k, v in self.settings.items():
                self.spark.conf.set(k, v)
            df.write.option("compression", "zstd").parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete written tables; their DataFrames must not be used again."""
        for table in tables:
            jvm = self.spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(table.scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_column(df: DataFrame, name: str = "text"):
    """The text as a string, empty where null."""
    return F.coalesce(df[name].cast("string"), F.lit(""))
