"""Joins with a side of few rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a narrow table (a class, a number) that go to every task.
FEW_ROWS = 100_000


def join_small(big: DataFrame, small: DataFrame, on: str | list[str], most: int = FEW_ROWS) -> DataFrame:
    """Inner join that leaves ``big`` where it is while ``small``, a narrow table, has
    at most ``most`` rows. It is counted first, so write it or checkpoint it if it is
    costly. With more rows there are many keys, and the join is a shuffle whose skewed
    partitions adaptive execution splits."""
    few = small.limit(most + 1).count() <= most
    return big.join(F.broadcast(small) if few else small, on)
