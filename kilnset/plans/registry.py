"""Registry of queries: the Spark job, its SQL twin, the inventory ids."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from kilnset.tables import Tables


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[Tables], DataFrame]
    sql: str | None
    covers: tuple[str, ...]


QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a function ``Tables -> DataFrame`` under ``name``."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, fn, sql, tuple(covers.split()))
        return fn

    return add


def u(tag: str, seed, epoch, *keys: str) -> str:
    """SQL text of ``functions.hashing.uniform``."""
    parts = [f"'{tag}'", f"cast({seed} as varchar)", f"cast({epoch} as varchar)"]
    parts += [f"cast({k} as varchar)" for k in keys]
    return f"((('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 13))::bigint) / 4503599627370496.0)"
