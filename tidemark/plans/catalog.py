"""Registry of every query: name -> (spark, sf_dir) -> DataFrame, plus oracle SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import oracle_views
from tidemark.session import apply_sql_defaults
from tidemark.sources.bindings import MarketData

_MODULES = ("tidemark.plans.picks", "tidemark.plans.market", "tidemark.plans.ingest",
            "tidemark.plans.coverage", "tidemark.plans.stats", "tidemark.plans.watchlist", "tidemark.plans.io",
            "tidemark.plans.loading")


def _load():
    import importlib

    queries, oracle = {}, {}
    for m in _MODULES:
        mod = importlib.import_module(m)
        for k, fn in mod.QUERIES.items():
            if k in queries:
                raise ValueError(f"duplicate query {k}")
            queries[k] = fn
        oracle.update(getattr(mod, "ORACLE", {}))
    return queries, oracle


def market_data(spark: SparkSession, sf_dir: str) -> MarketData:
    """Stored logical tables (materialised once per session) unless TIDEMARK_STORE=0."""
    if os.environ.get("TIDEMARK_STORE", "1") == "0":
        return MarketData(spark, sf_dir)
    from tidemark.sources.store import StoredMarketData
    return StoredMarketData(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    raw, _ = _load()

    def bind(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_sql_defaults(spark)
            return fn(market_data(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        return run

    return {k: bind(fn) for k, fn in raw.items()}


def oracle_sql() -> dict[str, str]:
    _, raw = _load()
    return {k: oracle_views.with_views(v) for k, v in raw.items()}
