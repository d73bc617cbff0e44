"""Runs of equal keys in sorted Arrow batches.

``repartition(keys)`` and ``sortWithinPartitions(keys)`` bring the rows of a key
together; ``runs`` hands them out one key at a time while the batches stream by.
Meant for many small groups of a bounded size: it holds one group, not one
partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of the rows that agree in the first ``keys`` (integer) columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        cells = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(n, dtype=bool)
        for c in cells:
            change[1:] |= c[1:] != c[:-1]
        begin = [0, *np.flatnonzero(change).tolist(), n]
        first = tuple(int(c[0]) for c in cells)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(begin, begin[1:]):
            if a and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(int(c[-1]) for c in cells)
    if held:
        yield pa.Table.from_batches(held)


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a key together and in order, keys first."""
    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys)


def block_pairs(members: DataFrame, blocks: str, block: str) -> DataFrame:
    """Every member once for each pair of blocks (i <= j) that its own block
    is in: columns ``i`` and ``j`` are added."""
    other = F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int"))).alias("__other")
    out = members.select("*", other)
    return out.withColumn("i", F.least(block, "__other").cast("int")).withColumn(
        "j", F.greatest(block, "__other").cast("int")).drop("__other")
