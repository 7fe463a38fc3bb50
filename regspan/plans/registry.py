"""Named queries, each next to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from regspan.plans import views
from regspan.plans.fixtures import Fixtures

QUERIES: dict[str, Callable[[Fixtures], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register a query; ``sql`` may name any view of ``views.VIEWS``."""

    def add(fn: Callable[[Fixtures], DataFrame]):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = views.with_views(sql)
        return fn

    return add


def as_callable(fn: Callable[[Fixtures], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(Fixtures(spark, sf_dir))
