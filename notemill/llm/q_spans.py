"""Queries on text found character for character in several documents (problem 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.llm.blocks import pairs_within
from notemill.llm.spans import covered_chars, shared_spans
from notemill.session import cut
from notemill.sources.tables import table

SPAN = 200


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of documents with a common substring of at least 200 code points, copies included."""
    members, pairs, _ = shared_spans(table(spark, folder, "documents"), "doc_id", "text", SPAN)
    rep = members.groupBy("class").agg(F.min("id").alias("rep"))
    of = members.select("id", "class").join(rep, "class").select("id", "rep")
    x, y = of.select(F.col("id").alias("x"), F.col("rep").alias("a")), of.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    across = pairs.join(x, "a").join(y, "b").select("x", "y")
    within = pairs_within(cut(of, "spans-copies"), "rep", "id").select(F.col("a").alias("x"), F.col("b").alias("y"))
    both = across.unionByName(within)
    return both.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))


def p8_shared(spark: SparkSession, folder: str) -> DataFrame:
    """For each document: its class of equal texts, and how many of its code points stand in long spans found elsewhere."""
    docs = table(spark, folder, "documents")
    members, _, covered = shared_spans(docs, "doc_id", "text", SPAN)
    rep = members.groupBy("class").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    of = members.join(rep, "class").join(covered_chars(covered).withColumnRenamed("a", "rep"), "rep", "left")
    zero = F.lit(0).cast("bigint")
    held = of.select(F.col("id").alias("doc_id"), F.col("rep").alias("class_doc"), "copies", F.when(F.col("copies") > 1, F.col("n").cast("bigint")).otherwise(F.coalesce("shared", zero)).alias("shared_chars"))
    out = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("chars")).join(held, "doc_id", "left")
    return out.select(
        "doc_id", F.coalesce("class_doc", "doc_id").alias("class_doc"), "chars", F.coalesce("shared_chars", zero).alias("shared_chars"),
        F.round(F.coalesce(F.try_divide("shared_chars", "chars"), F.lit(0.0)), 6).alias("shared_part"),
    )


ORACLES = {
    "p8_found": """
WITH d AS (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200),
w AS (SELECT DISTINCT doc_id, md5(substr(text, i, 200)) AS h FROM d)
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM w a JOIN w b ON a.h = b.h AND a.doc_id < b.doc_id""",
    "p8_shared": """
WITH d AS (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200),
w AS (SELECT doc_id, i, md5(substr(text, i, 200)) AS h FROM d), twice AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)),
c AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM w JOIN twice USING (h)),
s AS (SELECT doc_id, CAST(sum(least(200, i - coalesce(p, i - 200))) AS BIGINT) AS shared FROM c GROUP BY doc_id),
same AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class_doc FROM documents WHERE length(text) >= 200)
SELECT d.doc_id, coalesce(class_doc, d.doc_id) AS class_doc, coalesce(length(text), 0) AS chars, coalesce(shared, 0) AS shared_chars,
  round(coalesce(CAST(shared AS DOUBLE) / nullif(length(text), 0), 0), 6) AS shared_part FROM documents d LEFT JOIN same USING (doc_id) LEFT JOIN s USING (doc_id)""",
}
QUERIES = {"p8_found": p8_found, "p8_shared": p8_shared}
