"""Queries on similar vectors (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.llm.permindex import nearest, nearest_to, prepared
from notemill.sources.tables import table

NEIGHBOURS, LEAST = 5, 0.85


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return prepared(table(spark, folder, "chunk_vectors"), "vec_id", ["model"], "vec", "dimension")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of vectors of one model, one among the 5 nearest of the other, with cosine at least 0.85."""
    near = nearest(_vectors(spark, folder), NEIGHBOURS, LEAST)
    return near.select(F.least("a", "b").alias("vec_a"), F.greatest("a", "b").alias("vec_b")).distinct()


def p2_knn(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 most similar vectors of every vector whose id is divisible by 20, whatever their cosine."""
    rows = _vectors(spark, folder)
    near = nearest_to(rows, rows.where("id % 20 = 0").select("id"), NEIGHBOURS)
    return near.select(F.col("a").alias("vec_id"), F.col("b").alias("neighbour"), F.round("cos", 6).alias("cosine"))


def p2_knn_exact(spark: SparkSession, folder: str) -> DataFrame:
    """p2_knn without approximation: every row is reranked for every query."""
    rows = _vectors(spark, folder)
    near = nearest_to(rows, rows.where("id % 20 = 0").select("id"), NEIGHBOURS, share=1.0)
    return near.select(F.col("a").alias("vec_id"), F.col("b").alias("neighbour"), F.round("cos", 5).alias("cosine"))


def p2_recall(spark: SparkSession, folder: str) -> DataFrame:
    """One row: the queries, their neighbours, and whether p2_knn has at least nine tenths of those of p2_knn_exact."""
    keys = ["vec_id", "neighbour"]
    found = p2_knn(spark, folder).select(*keys, F.lit(1).alias("hit"))
    both = p2_knn_exact(spark, folder).select(*keys).join(found, keys, "left")
    return both.agg(F.count_distinct("vec_id").alias("queries"), F.count(F.lit(1)).alias("neighbours"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("recall_ok"))


_VALID = """
WITH v AS (SELECT DISTINCT ON (vec_id) vec_id, model, CAST(vec AS DOUBLE[]) AS vec FROM chunk_vectors
  WHERE vec IS NOT NULL AND len(vec) = dimension AND NOT list_contains(list_transform(vec, lambda x: isnan(x)), true) AND list_max(list_transform(vec, lambda x: abs(x))) > 0)"""
ORACLES = {
    "p2_knn_exact": _VALID
    + """, sims AS (SELECT a.vec_id, b.vec_id AS neighbour, list_cosine_similarity(a.vec, b.vec) AS s FROM v a JOIN v b ON a.model = b.model AND a.vec_id <> b.vec_id AND len(a.vec) = len(b.vec) WHERE a.vec_id % 20 = 0)
SELECT vec_id, neighbour, round(s, 5) AS cosine FROM sims QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, neighbour) <= 5""",
    "p2_recall": _VALID
    + """, n AS (SELECT a.vec_id, least(5, count(*)) AS n FROM v a JOIN v b ON a.model = b.model AND a.vec_id <> b.vec_id AND len(a.vec) = len(b.vec) WHERE a.vec_id % 20 = 0 GROUP BY 1)
SELECT count(*) AS queries, CAST(sum(n) AS BIGINT) AS neighbours, true AS recall_ok FROM n""",
    "p2_found": """
WITH v AS (SELECT DISTINCT ON (vec_id) vec_id, model, CAST(vec AS DOUBLE[]) AS vec FROM chunk_vectors
  WHERE vec IS NOT NULL AND len(vec) = dimension AND NOT list_contains(list_transform(vec, lambda x: isnan(x)), true) AND list_max(list_transform(vec, lambda x: abs(x))) > 0),
sims AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.vec, b.vec) AS s FROM v a JOIN v b ON a.model = b.model AND a.vec_id <> b.vec_id AND len(a.vec) = len(b.vec)),
best AS (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM sims WHERE s >= 0.85)
SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM best WHERE r <= 5""",
}
QUERIES = {"p2_found": p2_found, "p2_knn": p2_knn, "p2_knn_exact": p2_knn_exact, "p2_recall": p2_recall}
