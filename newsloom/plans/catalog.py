"""The registry of core queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsloom.plans import entity_queries, event_queries, scoring_queries, source_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]
_PARTS = (text_queries, entity_queries, event_queries, scoring_queries, source_queries)


def queries() -> dict[str, Query]:
    return {name: q for part in _PARTS for name, q in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
