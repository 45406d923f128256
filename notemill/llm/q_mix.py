"""Queries on a training mix (problem 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.llm.mix import mixed, token_counts
from notemill.sources.tables import table


def _mix(spark: SparkSession, folder: str, vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    import public_tokenizers

    counts = token_counts(table(spark, folder, "documents"), "doc_id", "text", ["source"], vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return mixed(counts, table(spark, folder, "mix_targets"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The drawn copies in training order."""
    return _mix(spark, folder)[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share that each source really got."""
    return _mix(spark, folder)[1].withColumns({"actual_share": F.round("actual_share", 6), "planned_tokens": F.round("planned_tokens", 1)})


ORACLES: dict[str, str] = {}
QUERIES = {"p7_mix": p7_mix, "p7_shares": p7_shares}
