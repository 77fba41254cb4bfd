"""Registry of named queries: each is a Spark builder ``(spark, sf_dir) -> DataFrame``
plus (where the semantics are SQL-expressible) an independent DuckDB oracle string."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}

# Fixed parameters of the registered queries.
AS_OF = "2024-01-31 00:00:00"      # measurement clock for freshness and relative ranges
ROUND_DIGITS = 6                    # float aggregates (avg, stddev) are reported rounded


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def _utc(fn: QueryFn) -> QueryFn:
    """Every query computes on UTC clocks, whatever session it is given."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)
    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


def queries() -> dict[str, QueryFn]:
    _load()
    return {k: _utc(v[0]) for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}


def _load() -> None:
    # importing the modules fills REGISTRY
    from tessera.plans import (  # noqa: F401
        catalog_queries, check_queries, contact_queries, describe_queries, history_queries,
        kpi_queries, metric_queries, monitor_queries, name_queries, stream_queries,
    )
