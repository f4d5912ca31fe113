"""Query registry: key -> Spark builder (spark, sf_dir) and optional DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from roamer.plans.oracle_fixtures import with_views

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def register(key: str, oracle: str | None = None, ctes: dict[str, str] | None = None):
    """Decorator: register a builder; ``oracle`` is DuckDB SQL over the driver views."""

    def wrap(fn: Builder) -> Builder:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = with_views(oracle, ctes)
        return fn

    return wrap


def load_all() -> None:
    """Import every plan module so their keys register."""
    from roamer.plans import (  # noqa: F401
        catalog_plans,
        matching_plans,
        retrieval_plans,
        userstate_plans,
        misc_plans,
        currency_plans,
        scope_plans,
        index_plans,
        stream_plans,
        travel_plans,
    )
