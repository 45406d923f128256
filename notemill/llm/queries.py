"""The pN_ queries of this sub-package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from notemill.llm import q_cooccur, q_leaks, q_mix, q_pairs, q_spans, q_split, q_vectors

_MODULES = (q_pairs, q_vectors, q_split, q_cooccur, q_leaks, q_mix, q_spans)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for m in _MODULES for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _MODULES for k, q in m.ORACLES.items()}
