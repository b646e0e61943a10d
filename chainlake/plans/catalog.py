"""Registry of named queries: Spark implementation + DuckDB oracle SQL.

Each entry reads the driver's tables at ``sf_dir`` (through the Bronze
fixture views of ``chainlake.sources.fixtures``) and returns a DataFrame.
``__spark_entry__`` only re-exports this registry.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(key: str, oracle: str | None = None):
    def deco(fn):
        if key in QUERIES:
            raise KeyError(f"duplicate query {key}")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn
    return deco


def _load_all() -> None:
    # Importing the modules registers their queries.
    from chainlake.plans import (q_chain, q_ingest, q_medallion, q_pricing,  # noqa: F401
                                 q_quality, q_stats, q_tracker, q_sorted)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(ORACLES)
