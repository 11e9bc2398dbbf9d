"""Registry of named queries and the SQL each one is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .oracle_views import with_views
from .tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None, **more_views: str):
    """Register ``fn(tables) -> DataFrame``.

    ``views`` names the shared starting tables the SQL uses and ``more_views``
    adds query-specific ones, in order. Without ``sql`` the query is checked by
    unit tests only.
    """

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(views.split(), sql, more_views)
        return fn

    return register
