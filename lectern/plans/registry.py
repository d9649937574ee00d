"""Query name -> callable and DuckDB SQL, gathered from the query modules."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "corpus_split_report"
MODULES = ("queries_data", "queries_metrics", "queries_layout", "queries_rules", "queries_review")


def _gathered(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(import_module(f"lectern.plans.{m}"), name)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _gathered("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gathered("ORACLE_SQL")
