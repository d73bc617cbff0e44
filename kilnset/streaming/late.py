"""Rows that arrive behind the watermark, kept in a side table instead of dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class LateRows:
    """A ``foreachBatch`` handler that splits each micro-batch by the watermark.

    The watermark of a micro-batch is the latest time of all earlier ones less
    ``delay``, as the engine's own; rows before it are late. Rows without a time are
    never late and move nothing. A micro-batch that is run again overwrites what it
    wrote; the state is one latest time for each micro-batch.
    """

    def __init__(self, spark: SparkSession, base: str, ts: str, delay: str):
        self.spark, self.base, self.ts, self.delay = spark, base, ts, delay
        self.schema = None

    def __call__(self, batch: DataFrame, n: int) -> None:
        self.schema = batch.schema
        kind = self.schema[self.ts].dataType
        high = self._rows().where(F.col("__batch") < n).agg(F.max(self.ts).cast("string")).first()[0] if n else None
        watermark = F.lit(high).cast(kind) - F.expr(f"interval {self.delay}")
        late = F.coalesce(F.col(self.ts) < watermark, F.lit(False)).cast("int")
        batch.withColumn("__late", late).write.mode("overwrite").partitionBy("__late").parquet(f"{self.base}/rows/__batch={n}")

    def _rows(self) -> DataFrame:
        # the folder names carry the batch and the verdict
        whole = T.StructType([*self.schema, T.StructField("__batch", T.LongType()), T.StructField("__late", T.IntegerType())])
        return self.spark.read.schema(whole).option("basePath", f"{self.base}/rows").parquet(f"{self.base}/rows/*")

    def rows(self) -> DataFrame:
        """All rows with a ``late`` flag."""
        return self._rows().withColumn("late", F.col("__late") == 1).drop("__batch", "__late")
