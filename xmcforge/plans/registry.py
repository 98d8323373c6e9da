"""Registry of named jobs: the Spark callable and, when SQL can state it, the DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from xmcforge.plans.fixtures import Tables, with_views

JOBS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def job(name: str, oracle: str | None = None):
    """Register ``fn(t: Tables) -> DataFrame`` under ``name`` with an optional oracle SQL."""
    def deco(fn: Callable[[Tables], DataFrame]):
        if name in JOBS:
            raise KeyError(f"duplicate job {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        JOBS[name] = run
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers jobs."""
    import importlib
    for mod in ("jobs_core", "jobs_fusion", "jobs_prep", "jobs_sampling", "jobs_represent",
                "jobs_cluster", "jobs_stream", "jobs_ann", "jobs_losses", "jobs_hooks", "jobs_subwords"):
        importlib.import_module(f"xmcforge.plans.{mod}")
