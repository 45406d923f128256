"""The current state of notes that come as several revisions and deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def current_rows(notes: DataFrame, fields: dict[str, Column], key: str = "note_id", rev: str = "rev") -> DataFrame:
    """One row per key with ``fields`` taken from its row of highest revision.

    Rows of the highest revision agree, so any of them will do.  A null key is no note and is left out; a null
    revision counts as the lowest.  The fields are computed before the shuffle and aggregated one by one, so only those travel
    that are used later, and the scan reads no more; the partial aggregation drops stale rows on the map side.
    """
    order = F.coalesce(F.col(rev).cast("bigint"), F.lit(-(2**63)))
    rows = notes.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), order.alias("_rev"), *[c.alias(n) for n, c in fields.items()])
    out = rows.groupBy("_key").agg(*[F.max_by(n, "_rev").alias(n) for n in fields])
    return out.withColumnRenamed("_key", key)


def live_notes(notes: DataFrame, fields: dict[str, Column], key: str = "note_id", rev: str = "rev", deleted_at: str = "deleted_at") -> DataFrame:
    """:func:`current_rows` without the deleted notes."""
    rows = current_rows(notes, {**fields, "_deleted": F.col(deleted_at).isNotNull()}, key, rev)
    return rows.where(~F.col("_deleted")).drop("_deleted")


def notes_table(notes: DataFrame) -> DataFrame:
    """The live notes as one row each: vault, path, ord (tie-breaker), last_modified, size, content_hash, frontmatter,
    title, content, chunks, tags, links.

    The title is the frontmatter's, where that is readable JSON; null columns stay null.
    """
    plain = ("vault", "path", "last_modified", "size", "content_hash", "frontmatter", "content", "chunks", "tags", "links")
    rows = live_notes(notes, {c: F.col(c) for c in plain})
    return rows.withColumnRenamed("note_id", "ord").withColumn("title", frontmatter_value("frontmatter", "title"))


def frontmatter_value(frontmatter: str, key: str) -> Column:
    """A frontmatter entry's JSON text as a string; null where it is absent or not JSON."""
    return F.get_json_object(F.concat(F.lit('{"v":'), F.try_element_at(F.col(frontmatter), F.lit(key)), F.lit("}")), "$.v")


def index_stats(notes: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """Per vault: notes, their size in all, and with vectors (vault, path) how many there are."""
    out = notes.groupBy("vault").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("total_size"), F.max("last_modified").alias("last_modified"))
    if vectors is None:
        return out
    n = vectors.groupBy("vault").agg(F.count(F.lit(1)).alias("embeddings"))
    return out.join(n, "vault", "left").withColumn("embeddings", F.coalesce("embeddings", F.lit(0).cast("bigint")))


def changed_paths(indexed: DataFrame, listing: DataFrame) -> DataFrame:
    """(path, change) between an index and a fresh listing (both path, mtime): add, change (newer), unlink."""
    a, b = indexed.select("path", F.col("mtime").alias("_old")), listing.select("path", F.col("mtime").alias("_new"))
    change = F.when(F.col("_old").isNull(), "add").when(F.col("_new").isNull(), "unlink").when(F.col("_new") > F.col("_old"), "change")
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).where(F.col("change").isNotNull())


def substring_search(notes: DataFrame, query: str, plain: Column) -> DataFrame:
    """Notes whose plain text, title or a tag holds the query, letter case aside."""
    q = F.lit(query.lower())
    tags = F.exists(F.coalesce(F.col("tags"), F.array().cast("array<string>")), lambda t: F.coalesce(F.contains(F.lower(t), q), F.lit(False)))
    return notes.where(F.contains(F.lower(plain), q) | F.coalesce(F.contains(F.lower("title"), q), F.lit(False)) | tags)
