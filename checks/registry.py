"""The list of checked queries: how Spark answers each and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks.fixtures import table, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def check(name: str, source: str | tuple[str, ...], sql: str | None):
    """Register a query over one or more tables. ``sql`` reads the same tables or views by name."""
    from checks.fixtures import VIEWS

    sources = (source,) if isinstance(source, str) else source
    views = [s for s in sources if s in VIEWS]

    def register(build: Callable[..., DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(*[table(spark, sf_dir, s) for s in sources])
        if sql is not None:
            ORACLES[name] = with_views(sql, *views) if views else sql
        return build

    return register
