"""The queries outside the optional subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = (
    "operators.row_parsing", "operators.dedupe", "plans.model_queries", "plans.text_queries", "plans.rule_queries", "plans.adapter_queries", "plans.import_queries", "plans.language_queries",
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in MODULES:
        found |= import_module(f"quellmark.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found |= getattr(import_module(f"quellmark.{name}"), "SQL", {})
    return found


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["judge_documents"](spark, sf_dir)
