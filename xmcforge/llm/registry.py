"""Queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``."""
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def load_all() -> None:
    import importlib
    for module in MODULES:
        importlib.import_module(f"xmcforge.llm.{module}")


MODULES = ["token_counts", "quality", "mixing", "sharding", "packing", "warc", "toxicity", "substrings", "jaccard", "neighbours",
           "minhash", "importance", "alignment"]
