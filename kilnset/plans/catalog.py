"""All registered queries (importing the modules registers them)."""

import importlib

from kilnset.plans.registry import QUERIES

MODULES = ("sampling", "batching", "joins", "metrics", "sources", "images", "policies", "scalars", "streams")

for _m in MODULES:
    importlib.import_module(f"kilnset.plans.{_m}")

__all__ = ["QUERIES"]
