"""Queries on evaluation items in training documents (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.llm.leaks import leaks
from notemill.sources.tables import table


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"), "doc_id", "text", "item_id", "text")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Which item leaked into which document."""
    return _leaks(spark, folder).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).distinct()


def p6_items(spark: SparkSession, folder: str) -> DataFrame:
    """For each item: in how many documents it leaked, and the greatest share of it found in one."""
    items = table(spark, folder, "eval_items").select("item_id", "item_set")
    per = _leaks(spark, folder).groupBy(F.col("item").alias("item_id")).agg(F.count_distinct("doc").alias("docs"), F.round(F.max("covered"), 6).alias("covered"))
    return items.join(per, "item_id", "left").select("item_id", "item_set", F.coalesce("docs", F.lit(0).cast("bigint")).alias("docs"), F.coalesce("covered", F.lit(0.0)).alias("covered"))


ORACLES: dict[str, str] = {}
QUERIES = {"p6_found": p6_found, "p6_items": p6_items}
