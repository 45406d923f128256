"""The catalog of named queries of the core."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from notemill.plans import check_queries, graph_queries, note_queries, orphan_queries, search_queries, vault_queries

_MODULES = (note_queries, search_queries, graph_queries, check_queries, orphan_queries, vault_queries)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return search_queries.text_search(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for m in _MODULES for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _MODULES for k, q in m.ORACLES.items()}
