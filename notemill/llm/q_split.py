"""Queries on chunks above their vault's limit (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notemill.llm.split import measured, split_oversized
from notemill.operators.notes import current_rows
from notemill.sources.tables import table


def _live_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """(note_id, chunk_ix, chunk, max_chunk_size, size_unit, chunk_overlap) of the live notes' current rows.

    A first pass over small columns finds the current revision of each live note; its rows then give their chunks, once for
    each delivery.
    """
    notes = table(spark, folder, "notes")
    order = F.coalesce(F.col("rev").cast("bigint"), F.lit(-(2**63)))
    stamped = notes.select("note_id", "vault", "chunks", "deleted_at", order.alias("rev"))
    now = current_rows(stamped, {"rev": F.col("rev"), "gone": F.col("deleted_at").isNotNull()}).where("NOT gone").select("note_id", "rev")
    rows = stamped.join(now, ["note_id", "rev"]).select("note_id", "vault", F.posexplode("chunks").alias("chunk_ix", "chunk"))
    limits = table(spark, folder, "vaults").select("vault", "max_chunk_size", "size_unit", "chunk_overlap")
    return rows.join(limits, "vault", "left")


def _pieces(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    chunks = _live_chunks(spark, folder)
    return split_oversized(chunks, ["note_id", "chunk_ix", *more], "chunk", "max_chunk_size", "size_unit", "chunk_overlap")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks that had to be cut, or could not be: those with a second piece or one above the limit."""
    pieces = _pieces(spark, folder, "max_chunk_size", "size_unit").where("oversized")
    return pieces.where((F.col("piece_ix") > 0) | (measured("piece", "size_unit") > F.col("max_chunk_size"))).select("note_id", "chunk_ix").distinct()


def p3_checked(spark: SparkSession, folder: str) -> DataFrame:
    """Each chunk's pieces put to the test: all within the limit, from its first to its last character without a gap, each
    sharing its overlap with the one before, and the text of their places."""
    keys = ["note_id", "chunk_ix"]
    p = _pieces(spark, folder, "chunk", "max_chunk_size", "size_unit", "chunk_overlap").dropDuplicates([*keys, "piece_ix"])
    w = Window.partitionBy(*keys).orderBy("piece_ix")
    p = p.withColumn("before", F.lag("end").over(w))
    shared = measured(F.substring("chunk", F.col("start") + 1, F.col("before") - F.col("start")), "size_unit")
    same = F.col("piece") == F.substring("chunk", F.col("start") + 1, F.col("end") - F.col("start"))
    return p.groupBy(*keys).agg(
        F.max("end").cast("bigint").alias("chars"), F.bool_and(measured("piece", "size_unit") <= F.col("max_chunk_size")).alias("within"),
        (F.min("start") == 0).alias("from_start"), F.bool_and(F.col("before").isNull() | (F.coalesce(shared, F.lit(0)) >= F.col("chunk_overlap"))).alias("shares"), F.bool_and(same).alias("same_text"),
    )


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every live note as pieces within its limit."""
    return _pieces(spark, folder).dropDuplicates(["note_id", "chunk_ix", "piece_ix"])


_CHUNKS = """
WITH cur AS (SELECT note_id, max(rev) AS rev FROM notes GROUP BY note_id),
live AS (SELECT n.note_id, any_value(vault) AS vault, any_value(chunks) AS chunks FROM notes n JOIN cur c ON n.note_id = c.note_id AND n.rev = c.rev WHERE n.deleted_at IS NULL GROUP BY n.note_id),
each AS (SELECT note_id, vault, unnest(chunks) AS chunk, unnest(range(len(chunks))) AS ix FROM live)
"""
ORACLES = {
    "p3_found": _CHUNKS
    + """SELECT note_id, CAST(ix AS INTEGER) AS chunk_ix FROM each e JOIN vaults v ON e.vault = v.vault
WHERE CASE size_unit WHEN 'chars' THEN length(chunk) WHEN 'utf8_bytes' THEN strlen(chunk)
  ELSE length(chunk) + length(regexp_replace(chunk, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) END > max_chunk_size""",
    "p3_checked": _CHUNKS + "SELECT note_id, CAST(ix AS INTEGER) AS chunk_ix, length(chunk) AS chars, true AS within, true AS from_start, true AS shares, true AS same_text FROM each WHERE chunk IS NOT NULL",
}
QUERIES = {"p3_found": p3_found, "p3_pieces": p3_pieces, "p3_checked": p3_checked}
