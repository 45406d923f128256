"""Queries on dangling references (problem 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.functions.keys import path_key, target_key
from notemill.operators.orphans import OrphanState, orphans, replay, snapshot
from notemill.sources.tables import table


def _vault_key(vault: Column, key: Column) -> Column:
    return F.concat(vault, F.lit("\x00"), key)


def _parents(notes: DataFrame) -> DataFrame:
    """Two parent rows for each row of a note: by path key and by id."""
    spaces = F.explode(
        F.array(
            F.struct(F.lit("path").alias("space"), _vault_key(F.col("vault"), path_key("path")).alias("key")),
            F.struct(F.lit("note").alias("space"), F.col("note_id").cast("string").alias("key")),
        )
    )
    return notes.select(
        spaces.alias("_s"), F.col("note_id").cast("string").alias("owner"), F.col("rev").cast("bigint").alias("version"),
        F.col("deleted_at").isNull().alias("live"), "arrived_at",
    ).select("_s.space", "_s.key", "owner", "version", "live", "arrived_at")


def _link_refs(links: DataFrame) -> DataFrame:
    fields = F.explode(
        F.array(
            F.struct(F.lit("target").alias("ref_field"), _vault_key(F.col("vault"), target_key("source", "target")).alias("key")),
            F.struct(F.lit("source").alias("ref_field"), _vault_key(F.col("vault"), path_key("source")).alias("key")),
        )
    )
    return links.select(F.lit("links").alias("ref_table"), fields.alias("_f"), F.col("link_id").alias("ref_id"), F.lit("path").alias("space"), F.col("seen_at")).select(
        "ref_table", "_f.ref_field", "ref_id", "space", "_f.key", "seen_at"
    )


def _vector_refs(vectors: DataFrame) -> DataFrame:
    return vectors.select(
        F.lit("chunk_vectors").alias("ref_table"), F.lit("note_id").alias("ref_field"), F.col("vec_id").alias("ref_id"), F.lit("note").alias("space"),
        F.col("note_id").cast("string").alias("key"), F.col("embedded_at").alias("seen_at"),
    )


def _state(spark: SparkSession, folder: str) -> OrphanState:
    """Two batches, as the tables were delivered before and after the middle of the notes' time of ingestion."""
    notes, links, vectors = (table(spark, folder, t) for t in ("notes", "links", "chunk_vectors"))
    seconds = F.unix_timestamp("ingested_at")
    middle = notes.agg(F.timestamp_seconds(((F.min(seconds) + F.max(seconds)) / 2).cast("bigint"))).first()[0]
    early = (lambda c: F.coalesce(F.col(c) <= F.lit(middle), F.lit(True))) if middle else (lambda c: F.lit(True))
    batches = []
    for part in (lambda c: early(c), lambda c: ~early(c)):
        refs = _link_refs(links.where(part("ingested_at"))).unionByName(_vector_refs(vectors.where(part("embedded_at"))))
        batches.append((refs, _parents(notes.where(part("ingested_at")))))
    return replay(spark, batches)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """One row per bad reference of links and chunk_vectors."""
    return orphans(_state(spark, folder))


def p5_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """References and orphans per table, field and month."""
    return snapshot(_state(spark, folder))


#: Expressions that the SQL texts share.
_PATH_KEY = "regexp_replace(lower(trim(regexp_replace(replace({0}, '\\', '/'), '/+', '/', 'g'), ' /')), '\\.md$', '')"
_RAW = "trim(replace(url_decode(split_part(target, '#', 1)), '\\', '/'))"
_FOLD = """array_to_string(list_reduce(list_transform(string_split({0}, '/'), lambda p: [p]),
  lambda acc, p: CASE WHEN p[1] IN ('', '.') THEN acc WHEN p[1] = '..' THEN acc[1:greatest(len(acc) - 1, 0)] ELSE list_concat(acc, p) END,
  []::VARCHAR[]), '/')"""
_STATE_SQL = f"""
WITH l0 AS (SELECT DISTINCT link_id, vault, source, target, seen_at FROM links),
l1 AS (SELECT *, {_PATH_KEY.format("source")} AS skey, {_RAW} AS raw FROM l0),
l2 AS (SELECT *, CASE WHEN raw = '' THEN skey ELSE {_PATH_KEY.format(_FOLD.format("CASE WHEN starts_with(raw, '/') THEN raw ELSE regexp_replace(skey, '[^/]*$', '') || raw END"))} END AS tkey FROM l1),
cur AS (SELECT note_id, vault, {_PATH_KEY.format("path")} AS k, max(rev) AS r, min(arrived_at) AS arrived_at FROM notes GROUP BY 1, 2, 3),
par AS (SELECT DISTINCT c.note_id, c.vault, c.k, c.arrived_at, n.deleted_at IS NULL AS live FROM cur c JOIN notes n ON n.note_id = c.note_id AND n.rev = c.r),
refs AS (
  SELECT 'links' AS ref_table, 'target' AS ref_field, link_id AS ref_id, vault || '|' || tkey AS key, seen_at FROM l2
  UNION ALL SELECT 'links', 'source', link_id, vault || '|' || skey, seen_at FROM l2
  UNION ALL SELECT 'chunk_vectors', 'note_id', vec_id, CAST(note_id AS VARCHAR), embedded_at FROM (SELECT DISTINCT vec_id, note_id, embedded_at FROM chunk_vectors)),
keyed AS (SELECT vault || '|' || k AS key, live, arrived_at FROM par UNION ALL SELECT CAST(note_id AS VARCHAR), live, arrived_at FROM par),
judged AS (SELECT ref_table, ref_field, ref_id, seen_at, strftime(seen_at, '%Y-%m') AS seen_month,
  CASE WHEN p.key IS NULL THEN 'missing' WHEN NOT live THEN 'deleted' WHEN arrived_at > seen_at THEN 'late' END AS reason
  FROM refs LEFT JOIN keyed p ON refs.key = p.key)
"""
QUERIES = {"p5_found": p5_found, "p5_snapshot": p5_snapshot}
ORACLES = {
    "p5_found": _STATE_SQL + "SELECT ref_table, ref_field, ref_id, reason, seen_month FROM judged WHERE reason IS NOT NULL",
    "p5_snapshot": _STATE_SQL
    + """SELECT ref_table, ref_field, seen_month, count(*) AS refs, count(*) FILTER (reason = 'missing') AS missing,
  count(*) FILTER (reason = 'deleted') AS deleted, count(*) FILTER (reason = 'late') AS late FROM judged GROUP BY 1, 2, 3""",
}
