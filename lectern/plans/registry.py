"""Named queries and the SQL each one is checked against."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import Tables

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``build(tables)`` under ``name``."""
    def add(build: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql is not None:
            from .oracle import with_views
            _SQL[name] = with_views(sql)
        return build
    return add


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def _load() -> None:
    from . import (queries_access, queries_bookkeeping, queries_build, queries_extract, queries_functions,  # noqa: F401
                   queries_lexical, queries_reports, queries_retrieval, queries_streams)
