"""All queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = (
    "p01_splits", "p02_overlap", "p04_duplicates", "p05_consensus", "p06_lookalikes", "p07_languages", "p08_packing", "p09_leakage", "p10_truncation",
)

#: Imported with this module: where one of them can't be, none is offered.
_LOADED = [import_module(f"quellmark.llm.{name}") for name in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for module in _LOADED:
        found |= module.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in _LOADED:
        found |= getattr(module, "SQL", {})
    return found
