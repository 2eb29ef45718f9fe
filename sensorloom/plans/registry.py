"""Query registry: name -> (spark, sf_dir) -> DataFrame, plus DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import Fixtures
from .views_sql import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None, views=()):
    """Register ``fn(fx: Fixtures) -> DataFrame`` under ``name``.

    ``sql`` is the DuckDB oracle over the base tables; ``views`` names the
    fixture views it needs (added as CTEs).  No ``sql`` = rows-only check."""

    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Fixtures(spark, sf_dir))

        run.__name__ = f"q_{name}"
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = with_views(views, sql.strip())
        return fn

    return deco
