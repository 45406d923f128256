"""Queries on tags that appear together (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.functions.keys import normal_tags
from notemill.llm.cooccur import cooccurrence
from notemill.operators.notes import live_notes
from notemill.sources.tables import table


def _live_tags(spark: SparkSession, folder: str) -> DataFrame:
    return live_notes(table(spark, folder, "notes"), {"tags": normal_tags("tags")})


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of tags that meet in at least 6 and 1/500 of the live notes, three times as often as chance."""
    pairs = cooccurrence(_live_tags(spark, folder), "note_id", "tags", min_count=6, min_share=500)
    often = F.col("n_ab") * F.col("total") >= 3 * F.col("n_a") * F.col("n_b")
    return pairs.where(often).select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"))


def p4_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of tags with their counts, lift and odds ratio."""
    return cooccurrence(_live_tags(spark, folder), "note_id", "tags").select(
        F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"), "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"), F.round("odds_ratio", 6).alias("odds_ratio")
    )


def p4_recount(spark: SparkSession, folder: str) -> DataFrame:
    """tag_infos against the recount: one row per (tag, neighbour) whose stored count, over all shards, is wrong."""
    pairs = cooccurrence(_live_tags(spark, folder), "note_id", "tags")
    both = pairs.select(F.explode(F.array(F.struct(F.col("item_a").alias("tag"), F.col("item_b").alias("neighbour")), F.struct(F.col("item_b").alias("tag"), F.col("item_a").alias("neighbour")))).alias("p"), "n_ab")
    true = both.select("p.tag", "p.neighbour", F.col("n_ab").alias("counted"))
    infos = table(spark, folder, "tag_infos").select("tag", F.explode("co_occurring_tags").alias("neighbour", "stored"))
    held = infos.groupBy("tag", "neighbour").agg(F.sum("stored").alias("stored"))
    zero = F.lit(0).cast("bigint")
    out = true.join(held, ["tag", "neighbour"], "full_outer").withColumns({"counted": F.coalesce("counted", zero), "stored": F.coalesce("stored", zero)})
    return out.where("counted <> stored")


_COUNTS = """
WITH cur AS (SELECT note_id, max(rev) AS rev FROM notes GROUP BY note_id),
live AS (SELECT n.note_id, any_value(tags) AS tags FROM notes n JOIN cur c ON n.note_id = c.note_id AND n.rev = c.rev WHERE n.deleted_at IS NULL GROUP BY n.note_id),
held AS (SELECT DISTINCT note_id, tag FROM (SELECT note_id, regexp_replace(regexp_replace(trim(lower(t)), '^#', ''), '\\s+', '-', 'g') AS tag FROM (SELECT note_id, unnest(tags) AS t FROM live)) WHERE tag <> ''),
total AS (SELECT count(*) AS total FROM live), single AS (SELECT tag, count(*) AS n FROM held GROUP BY tag),
pair AS (SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS n_ab FROM held a JOIN held b ON a.note_id = b.note_id AND a.tag < b.tag GROUP BY 1, 2),
counted AS (SELECT tag_a, tag_b, n_ab, x.n AS n_a, y.n AS n_b, total FROM pair JOIN single x ON x.tag = tag_a JOIN single y ON y.tag = tag_b, total)
"""
QUERIES = {"p4_found": p4_found, "p4_pairs": p4_pairs, "p4_recount": p4_recount}
ORACLES = {
    "p4_found": _COUNTS + "SELECT tag_a, tag_b FROM counted WHERE n_ab >= 6 AND n_ab * 500 >= total AND n_ab * total >= 3 * n_a * n_b",
    "p4_pairs": _COUNTS
    + """SELECT tag_a, tag_b, n_ab, n_a, n_b, round(CAST(n_ab AS DOUBLE) * total / (CAST(n_a AS DOUBLE) * n_b), 6) AS lift,
  round(((n_ab + 0.5::DOUBLE) * (total - n_a - n_b + n_ab + 0.5::DOUBLE)) / ((n_a - n_ab + 0.5::DOUBLE) * (n_b - n_ab + 0.5::DOUBLE)), 6) AS odds_ratio FROM counted""",
    "p4_recount": _COUNTS
    + """, "true" AS (SELECT tag_a AS tag, tag_b AS neighbour, n_ab AS counted FROM counted UNION ALL SELECT tag_b, tag_a, n_ab FROM counted),
info AS (SELECT tag, unnest(map_entries(co_occurring_tags)) AS e FROM tag_infos),
stored AS (SELECT tag, e.key AS neighbour, CAST(sum(e.value) AS BIGINT) AS stored FROM info GROUP BY 1, 2)
SELECT coalesce(t.tag, s.tag) AS tag, coalesce(t.neighbour, s.neighbour) AS neighbour, coalesce(counted, 0) AS counted, coalesce(stored, 0) AS stored
FROM "true" t FULL OUTER JOIN stored s ON t.tag = s.tag AND t.neighbour = s.neighbour WHERE coalesce(counted, 0) <> coalesce(stored, 0)""",
}
