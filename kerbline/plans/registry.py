"""Every query of the package by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str = "", body: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``body`` is its SQL over the given tables and the named views."""

    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = function
        if body is not None:
            ORACLES[name] = sql(views, body)
        return function

    return add


def load_all() -> tuple[dict[str, Query], dict[str, str]]:
    from . import (  # noqa: F401
        audit_queries,
        box_queries,
        build_queries,
        event_queries,
        file_queries,
        review_queries,
        score_queries,
        source_queries,
        track_queries,
    )

    return QUERIES, ORACLES
