"""Query registry: one Spark query (and, where SQL can express it, one
independent DuckDB oracle) per operator of the inventory.

Each query takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole input tables. Queries run with ``rounded=False`` so that results are
comparable with the oracle at full precision.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pitwise.session import apply_conf

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_conf(spark)
            return fn(spark, sf_dir.rstrip("/"))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return deco


def load_all() -> None:
    """Import every query module (registration happens at import)."""
    from pitwise.plans import (q_ledger, q_lookback, q_model, q_scalar,  # noqa: F401
                               q_shops)
