"""All registered queries of the core and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Enter a query builder under ``name``, with its SQL where there is one."""

    def enter(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return enter


def _load() -> None:
    import importlib

    for module in MODULES:
        importlib.import_module(f"marlstone.plans.{module}")


#: Modules whose queries are registered when they are imported.
MODULES = ["corpus", "prompts", "search", "analytics", "changes", "requests", "publishing", "evaluation", "forms", "assembly", "pages"]


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Guarded lexical retrieval."""
    return queries()["lexical_guard"](spark, folder)
