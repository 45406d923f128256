"""Listings of notes and the health report of vaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.operators.notes import frontmatter_value


def created_at() -> Column:
    """The frontmatter's creation time where it can be read, else the last modification."""
    return F.coalesce(F.try_to_timestamp(frontmatter_value("frontmatter", "created")), F.col("last_modified"))


def listed(notes: DataFrame, pattern: str | None = None, sort_by: str = "modified", limit: int = 50) -> DataFrame:
    """(vault, path, size, modified): notes whose path matches a regex (letter case aside), sorted by name, size, created or
    modified; all but names descending, ties in the notes' order."""
    rows = notes if pattern is None else notes.where(F.col("path").rlike(f"(?iu){pattern}"))
    by = {"name": F.col("path").asc(), "size": F.desc_nulls_last("size"), "created": created_at().desc(), "modified": F.desc("last_modified")}
    if sort_by not in by:
        raise ValueError(f"sort_by must be one of {', '.join(by)}")
    return rows.orderBy(by[sort_by], "ord").limit(limit).select("vault", "path", "size", F.col("last_modified").alias("modified"))


def recent(notes: DataFrame, by: str = "modified", limit: int = 20, since: str | None = None) -> DataFrame:
    """(vault, path, title, modified, created, size) of the latest notes, by modification or creation."""
    rows = notes.withColumn("created", created_at())
    at = {"modified": "last_modified", "created": "created"}[by]
    if since is not None:
        rows = rows.where(F.col(at) >= F.lit(since).cast("timestamp"))
    rows = rows.orderBy(F.desc(at), "ord").limit(limit)
    return rows.select("vault", "path", F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("path")).alias("title"), F.col("last_modified").alias("modified"), "created", "size")


def file_metadata(notes: DataFrame) -> DataFrame:
    """(vault, path, title, size, modified, tags, links): the numbers of raw tags and links; 0 for null."""
    n = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).alias(c)
    return notes.select("vault", "path", "title", "size", F.col("last_modified").alias("modified"), n("tags"), n("links"))


def vault_health(notes: DataFrame, link_stats: DataFrame, tag_stats: DataFrame, index_stats: DataFrame) -> DataFrame:
    """One scorecard per vault: counts, four scores of 0 to 100, their grade, issues and recommendations.

    The scores: links not broken, nodes with incoming links, vectors per note, tags in use (a fresh index has no
    unused tag).  Issues are ``type:severity`` words, recommendations words.
    """
    untagged = F.count(F.when(F.coalesce(F.when(F.col("tags").isNotNull(), F.size("tags")), F.lit(0)) == 0, 1))
    n = notes.groupBy("vault").agg(F.count(F.lit(1)).alias("files"), untagged.alias("untagged"))
    t = tag_stats.groupBy("vault").agg(F.count(F.lit(1)).alias("tags"), F.sum("file_count").alias("uses"))
    e = index_stats.select("vault", "embeddings")
    zero = F.lit(0).cast("bigint")
    s = n.join(link_stats, "vault").join(t, "vault", "left").join(e, "vault", "left").withColumns({c: F.coalesce(c, zero) for c in ("tags", "uses", "embeddings")})

    def part(a: str, b: str) -> Column:
        return F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1)) * 100

    s = s.withColumns(
        {
            "connectivity": F.greatest(F.lit(0.0), 100 - part("broken", "links")), "organization": F.greatest(F.lit(0.0), 100 - part("orphans", "files")),
            "completeness": F.least(F.lit(100.0), part("embeddings", "files")), "consistency": F.lit(100.0), "tags_per_file": F.col("uses").cast("double") / F.col("files"),
        }
    )
    mean = (F.col("connectivity") + F.col("organization") + F.col("completeness") + F.col("consistency")) / 4
    grade = F.when(mean >= 80, "excellent").when(mean >= 60, "good").when(mean >= 40, "fair").otherwise("poor")

    def issue(name: str, n: str, of: str, share: float, high: str, low: str) -> Column:
        return F.when(F.col(n) > 0, F.concat(F.lit(name + ":"), F.when(F.col(n) > F.col(of) * share, high).otherwise(low)))

    issues = F.concat_ws(" ", issue("broken_links", "broken", "links", 0.1, "high", "medium"), issue("orphaned_files", "orphans", "files", 0.2, "high", "low"), issue("untagged_files", "untagged", "files", 0.3, "medium", "low"))
    advice = F.concat_ws(
        " ", F.when(F.col("broken") > 0, "fix_broken_links"), F.when(F.col("orphans") > 5, "connect_orphaned_files"), F.when(F.col("untagged") > F.col("files") * 0.2, "add_tags"),
        F.when(F.col("embeddings") < F.col("files") * 0.8, "build_embeddings"),
    )
    return s.select(
        "vault", "files", "untagged", "links", "broken", "orphans", "tags", "embeddings", "tags_per_file", "connectivity", "organization", "completeness", "consistency", grade.alias("overall"),
        issues.alias("issues"), advice.alias("recommendations"),
    )
