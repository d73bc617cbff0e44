"""Batches, micro-batches, lanes and collation."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kilnset.operators.sampling import permutation


def batch_length(df: DataFrame, batch_size: int, drop_last: bool) -> DataFrame:
    """One row: number of samples and of batches."""
    n = F.count(F.lit(1))
    batches = F.floor(n / batch_size) if drop_last else F.ceil(n / batch_size)
    return df.agg(n.alias("samples"), batches.alias("batches"))


def fixed_batches(df: DataFrame, batch_size: int, drop_last: bool = False, total: str = "n") -> DataFrame:
    """``batch_id`` and ``pos_in_batch`` from ``pos``; ``total`` holds the row
    count (``positions(.., total=..)``)."""
    out = df.withColumn("batch_id", F.floor(F.col("pos") / batch_size)).withColumn(
        "pos_in_batch", F.col("pos") % batch_size)
    if drop_last:
        out = out.where(F.col("batch_id") < F.floor(F.col(total) / batch_size))
    return out


def fetch_batches(
    samples: DataFrame, key: str, sampler: Callable[[DataFrame], DataFrame], batch_size: int, drop_last: bool = False
) -> DataFrame:
    """Samples in the batches of a user sampler: a function from the samples to
    (key, pos, n), n being the number of positions."""
    index = fixed_batches(sampler(samples).select(key, "pos", "n"), batch_size, drop_last)
    return samples.join(index.drop("pos", "n"), key)


def micro_batches(df: DataFrame, micro: int, mini: int, total: str = "n") -> DataFrame:
    """Two-level batch ids; an unfinished last micro-batch is always dropped."""
    if mini % micro:
        raise ValueError(f"mini-batch size {mini} is not a multiple of micro-batch size {micro}")
    return (
        df.withColumn("micro_id", F.floor(F.col("pos") / micro))
        .withColumn("mini_id", F.floor(F.col("pos") / mini))
        .where(F.col("micro_id") < F.floor(F.col(total) / micro))
    )


def micro_sizes(df: DataFrame, size: Column) -> DataFrame:
    """Bytes and rows per micro-batch."""
    return df.groupBy("mini_id", "micro_id").agg(
        F.count(F.lit(1)).alias("samples"), F.sum(size).alias("bytes"))


def replicate(df: DataFrame, copies: int) -> DataFrame:
    """Every batch row once per worker (``copy`` numbers the copies)."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))


def convert(dtype: T.DataType) -> T.DataType:
    """Tensor type of a field: doubles, longs, nested; strings pass."""
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return T.DoubleType()
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return T.LongType()
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(convert(dtype.elementType), dtype.containsNull)
    if isinstance(dtype, T.MapType):
        return T.MapType(dtype.keyType, convert(dtype.valueType), dtype.valueContainsNull)
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, convert(f.dataType), f.nullable) for f in dtype])
    return dtype


def default_convert(df: DataFrame, fields: list[str]) -> DataFrame:
    """Cast fields to their tensor types, row by row."""
    schema = df.schema
    return df.select(*[
        F.col(c).cast(convert(schema[c].dataType)).alias(c) if c in fields else F.col(c) for c in df.columns])


def _field(name: str):
    return lambda row: row[name]


def _stack(values: Column, dtype: T.DataType, name: str) -> Column:
    """Values of one field, stacked: structs field by field and maps key by key
    (the keys of the first value; a value without one gives null there). Lists
    must have one length, on every level of nesting."""
    if isinstance(dtype, T.StructType):
        return F.struct(*[
            _stack(F.transform(values, _field(f.name)), f.dataType, f"{name}.{f.name}").alias(f.name) for f in dtype])
    if isinstance(dtype, T.MapType):
        def of_key(k):
            return _stack(F.transform(values, lambda v: F.try_element_at(v, k)), dtype.valueType, f"{name} values")

        keys = F.map_keys(F.get(values, F.lit(0)))
        return F.map_from_arrays(keys, F.transform(keys, of_key))
    if isinstance(dtype, T.ArrayType):
        fail = F.raise_error(F.lit(f"each element of {name} in a batch must have equal size"))
        return F.when(_even(values, dtype), values).otherwise(fail)
    return values


def _even(values: Column, dtype: T.DataType) -> Column:
    """Whether lists, and lists inside them, have one length each."""
    one = F.size(F.array_distinct(F.transform(values, lambda v: F.size(v)))) <= 1
    if isinstance(dtype.elementType, T.ArrayType):
        return one & _even(F.flatten(values), dtype.elementType)
    return one


def collate(df: DataFrame, batch: list[str], order: str, fields: list[str]) -> DataFrame:
    """One row per batch: every field stacked in order, scalars and lists as
    arrays, structs and maps key by key. A batch is bounded by the batch size, so
    no group grows with the data."""
    others = [f for f in fields if f != order]
    rows = default_convert(df.select(*batch, order, *others), fields)
    packed = rows.groupBy(*batch).agg(
        F.count(F.lit(1)).alias("size"), F.collect_list(F.struct(order, *others)).alias("__rows"))
    # by the order column alone: maps can't be compared
    packed = packed.withColumn("__rows", F.array_sort("__rows", lambda a, b: F.when(a[order] < b[order], -1).when(
        a[order] > b[order], 1).otherwise(0)))
    return packed.select(*batch, "size", *[
        _stack(F.transform("__rows", _field(f)), rows.schema[f].dataType, f).alias(f) for f in fields])


def collate_with(df: DataFrame, batch: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """User collate function per batch (a batch is bounded by its size)."""
    return df.groupBy(*batch).applyInPandas(fn, schema)


def reassemble(df: DataFrame, mini: str, micro: str, values: Column) -> DataFrame:
    """Micro-batches into mini-batches: running offset of each micro-batch and
    the flattened content of the mini-batch."""
    parts = df.groupBy(mini, micro).agg(F.sort_array(F.collect_list(values)).alias("part"))
    before = Window.partitionBy(mini).orderBy(micro).rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("offset", F.coalesce(F.sum(F.size("part")).over(before), F.lit(0)))
    return placed.groupBy(mini).agg(
        F.sort_array(F.collect_list(F.struct(micro, "offset", "part"))).alias("parts")
    ).select(
        mini, F.transform("parts", lambda p: p["offset"]).alias("offsets"),
        F.flatten(F.transform("parts", lambda p: p["part"])).alias("content"),
    )


def size_lanes(micros: DataFrame, cpu_share: float) -> DataFrame:
    """Inside a mini-batch the smallest micro-batches go to the cpu lane, the
    largest to the gpu lane; equal sizes keep the later one first."""
    by_size = Window.partitionBy("mini_id").orderBy(F.col("bytes"), F.desc("micro_id"))
    whole = Window.partitionBy("mini_id")
    placed = micros.withColumn("place", F.row_number().over(by_size) - 1)
    quota = F.floor(F.count(F.lit(1)).over(whole) * cpu_share)
    return placed.withColumn("lane", F.when(F.col("place") < quota, F.lit("cpu")).otherwise(F.lit("gpu")))


def offload_lanes(df: DataFrame, batch_size: int, coefficient: float, workers: int, total: str = "n") -> DataFrame:
    """Prefix ``int(coefficient * len)`` of every batch goes to the remote
    lane, the rest to local workers in ceil chunks."""
    size = F.least(F.lit(batch_size), F.col(total) - F.col("batch_id") * batch_size)
    remote = F.floor(size * F.lit(coefficient))
    chunk = F.ceil((size - remote) / workers)
    place = F.col("pos_in_batch")
    return (
        df.withColumn("lane", F.when(place < remote, F.lit("remote")).otherwise(F.lit("local")))
        .withColumn("worker", F.when(place >= remote, F.floor((place - remote) / chunk)))
    )


def rejoin_lanes(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Batches restored from both lanes, in send order inside each batch."""
    both = remote.unionByName(local)
    return both.repartition("batch_id").sortWithinPartitions("batch_id", "pos_in_batch")


def epoch_batches(
    df: DataFrame, key: str, seed: int, epoch: int, replicas: int, micro: int, mini: int
) -> DataFrame:
    """One epoch: permutation, even rank shards, two-level batches per rank."""
    ranked = permutation(df, key, seed, epoch, total="__n")
    per_rank = F.ceil(F.col("__n") / replicas)
    ranked = ranked.withColumn("n", per_rank)
    copies = ranked.withColumn(
        "gpos", F.explode(F.sequence("pos", F.col("n") * replicas - 1, F.col("__n"))))
    shards = copies.withColumn("rank", F.col("gpos") % replicas).withColumn("pos", F.floor(F.col("gpos") / replicas))
    return micro_batches(shards, micro, mini).drop("__n", "n", "gpos")
