"""Bind values once for use inside lambda expressions.

A column expression used inside ``transform`` / ``aggregate`` is evaluated
again for every element. Binding it as the single element of an outer array
evaluates it once per row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(body: Callable[..., Column], *values) -> Column:
    """``body(v0, v1, ..)`` with every value evaluated once per row."""
    cols = [v if isinstance(v, Column) else F.lit(v) for v in values]
    packed = F.struct(*[c.alias(f"v{i}") for i, c in enumerate(cols)])
    return F.get(F.transform(F.array(packed), lambda s: body(*[s[f"v{i}"] for i in range(len(cols))])), F.lit(0))
