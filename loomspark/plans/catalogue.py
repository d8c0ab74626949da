"""All queries of the engine outside the training-data subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomspark.plans import chat_queries, data_queries, media_queries, source_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return chat_queries.queries() | data_queries.queries() | source_queries.queries() | media_queries.queries()


def oracle_sql() -> dict[str, str]:
    return chat_queries.oracle_sql() | data_queries.oracle_sql() | source_queries.oracle_sql() | media_queries.oracle_sql()
