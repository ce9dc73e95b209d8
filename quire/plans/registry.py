"""Registry of named queries: a Spark plan + (optionally) its DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from .oracle import with_views

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None, views=(), **ctes: str):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``.

    ``sql`` is the DuckDB statement computing the same rows; ``views`` lists
    the fixture views it reads (emitted as CTEs).
    """
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(views, sql, **ctes)
        return fn
    return deco
