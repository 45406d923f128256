"""Text, semantic and hybrid search over notes.

Every operator scores all notes with column expressions and keeps the best by a sorted limit, so a query costs one scan.
The reference time ``now`` is an argument: results do not depend on when they are computed.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.functions.text import hits, slash_path, term_matches
from notemill.functions.vectors import cosine
from notemill.operators.tags import files_by_tags
from notemill.session import cut


@dataclass(frozen=True)
class Weights:
    """Weights of the parts of a hybrid score (fixed defaults)."""

    semantic: float = 0.4
    tags: float = 0.3
    recency: float = 0.2
    backlinks: float = 0.1


@dataclass(frozen=True)
class Filters:
    """tags (all or any), paths (any regex, letter case aside), a closed range of last_modified, file endings."""

    tags: Sequence[str] = ()
    tag_mode: str = "and"
    paths: Sequence[str] = ()
    start: str | datetime | None = None
    end: str | datetime | None = None
    file_types: Sequence[str] = field(default_factory=tuple)


def terms_of(query: str) -> list[str]:
    return [t for t in re.split(r"\s+", query.lower()) if t]


def _sum(cols: Sequence[Column]) -> Column:
    out = F.lit(0).cast("bigint")
    for c in cols:
        out = out + c
    return out


def _tag_hits(term: str) -> Column:
    return F.size(F.filter(F.coalesce(F.col("tags"), F.array().cast("array<string>")), lambda t: F.coalesce(F.contains(F.lower(t), F.lit(term)), F.lit(False)))).cast("bigint")


def filtered(notes: DataFrame, filters: Filters | None, tags: DataFrame | None = None) -> DataFrame:
    """Notes that pass all filters; a date that cannot be read sets no bound."""
    if filters is None:
        return notes
    out = notes
    if filters.tags:
        if tags is None:
            raise ValueError("filtering by tags needs the note tags")
        out = out.join(files_by_tags(tags, filters.tags, filters.tag_mode), ["vault", "path"], "left_semi")
    if filters.paths:
        any_of = F.lit(False)
        for p in filters.paths:
            any_of = any_of | F.col("path").rlike(f"(?iu){p}")
        out = out.where(any_of)
    for bound, op in ((filters.start, "ge"), (filters.end, "le")):
        if bound is not None:
            at = F.try_to_timestamp(F.lit(str(bound)))
            ok = F.col("last_modified") >= at if op == "ge" else F.col("last_modified") <= at
            out = out.where(F.coalesce(ok, at.isNull()))
    if filters.file_types:
        out = out.where(F.lower(F.substring_index("path", ".", -1)).isin([t.lower().lstrip(".") for t in filters.file_types]))
    return out


def text_search(notes: DataFrame, query: str, plain: Column, limit: int = 100, case_sensitive: bool = False, per_vault: bool = False) -> DataFrame:
    """(vault, path, ord, content_hits, title_hits, tag_hits, score): hits count 1 in content, 3 in the title, 2 per tag;
    the score is their mean over the terms, at most 1.  Best first, ties in the notes' order."""
    terms = terms_of(query) if not case_sensitive else query.split()
    low = (lambda c: c) if case_sensitive else F.lower
    if not terms:
        return notes.select("vault", "path", "ord", *[F.lit(0).cast("bigint").alias(c) for c in ("content_hits", "title_hits", "tag_hits")], F.lit(0.0).alias("score")).where(F.lit(False))
    t = notes.select("vault", "path", "ord", low(plain).alias("_c"), low(F.coalesce("title", F.lit(""))).alias("_t"), "tags")
    t = t.select(
        "vault", "path", "ord", _sum([hits("_c", x) for x in terms]).alias("content_hits"), _sum([hits("_t", x) for x in terms]).alias("title_hits"),
        _sum([_tag_hits(x) for x in terms]).alias("tag_hits"),
    )
    t = t.where("content_hits + title_hits + tag_hits > 0")
    score = F.least((F.col("content_hits") + 3 * F.col("title_hits") + 2 * F.col("tag_hits")) / len(terms), F.lit(1.0))
    t = t.withColumn("score", score)
    if per_vault:
        w = Window.partitionBy("vault").orderBy(F.desc("score"), "ord")
        return t.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")
    return t.orderBy(F.desc("score"), "ord").limit(limit)


def matches(notes: DataFrame, query: str, plain: Column) -> DataFrame:
    """(vault, path, ord, type, text, context, position): every occurrence of every term in content and title."""
    each = []
    for term in terms_of(query):
        each += [term_matches(plain, term, "content"), term_matches(F.col("title"), term, "title")]
    if not each:
        return notes.select("vault", "path", "ord", F.lit("").alias("type"), F.lit("").alias("text"), F.lit("").alias("context"), F.lit(0).alias("position")).where(F.lit(False))
    return notes.select("vault", "path", "ord", F.explode(F.concat(*each)).alias("m")).select("vault", "path", "ord", "m.*")


def semantic_search(vectors: DataFrame, query: Sequence[float], threshold: float = 0.7, limit: int = 100) -> DataFrame:
    """(path, score): the greatest cosine of a note's chunk vectors (path, embedding) with the query, best first."""
    q = F.array(*[F.lit(float(x)) for x in query])
    best = vectors.select("path", cosine("embedding", q).alias("s")).groupBy("path").agg(F.max(F.greatest(F.col("s"), F.lit(0.0))).alias("score"))
    return best.where(F.col("score") >= threshold).orderBy(F.desc("score"), "path").limit(limit)


def most_similar(query: Sequence[float], candidates: DataFrame, threshold: float = 0.7, limit: int = 10) -> DataFrame:
    """The candidates (id, embedding) with cosine at least ``threshold``, best first: (id, similarity)."""
    q = F.array(*[F.lit(float(x)) for x in query])
    s = candidates.select("id", cosine("embedding", q).alias("similarity"))
    return s.where(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), "id").limit(limit)


def relevance(notes: DataFrame, query: str, ranks: DataFrame, now: datetime | str, weights: Weights = Weights(), semantic: DataFrame | None = None) -> DataFrame:
    """(vault, path, ord, semantic, tags, recency, backlinks, path_relevance, score) of every note.

    ``ranks`` (vault, node, rank) is joined on the normalized path.  ``semantic`` (vault, path, score) is optional: without
    it the part is 0.  The path relevance is reported and not part of the score.  Recency falls linearly over a year.
    """
    q = query.strip().lower()
    # an empty query has one empty term, which every tag and path contains
    terms = re.split(r"\s+", q)
    n = len(terms)
    at = F.lit(str(now)).cast("timestamp")
    p = F.lower("path")
    tag = F.when(F.size(F.coalesce("tags", F.array().cast("array<string>"))) == 0, F.lit(0.0)).otherwise(F.least(_sum([_tag_hits(t) for t in terms]) / n, F.lit(1.0)))
    recency = F.greatest(F.lit(0.0), 1 - (F.unix_micros(at) - F.unix_micros(F.col("last_modified").cast("timestamp"))) / F.lit(86_400_000_000.0) / 365)
    on_path = F.when(F.contains(p, F.lit(q)), F.lit(1.0)).otherwise(_sum([F.contains(p, F.lit(t)).cast("bigint") for t in terms]) / n)
    rows = notes.select("vault", "path", "ord", tag.alias("tags"), recency.alias("recency"), on_path.alias("path_relevance"), slash_path("path").alias("node"))
    rows = rows.join(ranks.select("vault", "node", F.col("rank").alias("backlinks")), ["vault", "node"], "left").withColumn("backlinks", F.coalesce("backlinks", F.lit(0.0)))
    if semantic is None:
        rows = rows.withColumn("semantic", F.lit(0.0))
    else:
        rows = rows.join(semantic.select("vault", "path", F.col("score").alias("semantic")), ["vault", "path"], "left").withColumn("semantic", F.coalesce("semantic", F.lit(0.0)))
    score = F.col("semantic") * weights.semantic + F.col("tags") * weights.tags + F.col("recency") * weights.recency + F.col("backlinks") * weights.backlinks
    return rows.select("vault", "path", "ord", "semantic", "tags", "recency", "backlinks", "path_relevance", score.alias("score"))


def search(
    notes: DataFrame, query: str, plain: Column, ranks: DataFrame, now: datetime | str, filters: Filters | None = None, tags: DataFrame | None = None,
    semantic: DataFrame | None = None, limit: int = 20, threshold: float = 0.0, candidates: int = 100, weights: Weights = Weights(),
) -> DataFrame:
    """Hybrid search: filter, then rank all candidates of an empty query, or the best ``candidates`` of the text search together
    with the semantic hits, by the weighted relevance; best first, ties in the notes' order."""
    pool = filtered(notes, filters, tags)
    if query.strip():
        keep = text_search(pool, query, plain, candidates).select("vault", "path")
        if semantic is not None:
            keep = keep.unionByName(semantic.select("vault", "path")).distinct()
        pool = pool.join(keep, ["vault", "path"], "left_semi")
    scored = relevance(pool, query, ranks, now, weights, semantic)
    return scored.where(F.col("score") >= threshold).orderBy(F.desc("score"), "ord").limit(limit)


def bulk_hits(notes: DataFrame, queries: Sequence[str], plain: Column, limit: int) -> DataFrame:
    """(query, vault, path, ord, score): the text search of several queries in one scan, the best ``limit`` of each."""
    lists = {q: terms_of(q) for q in dict.fromkeys(queries) if terms_of(q)}
    if not lists:
        return notes.select(F.lit("").alias("query"), "vault", "path", "ord", F.lit(0.0).alias("score")).where(F.lit(False))
    t = notes.select("vault", "path", "ord", F.lower(plain).alias("_c"), F.lower(F.coalesce("title", F.lit(""))).alias("_t"), "tags")
    points = {q: (_sum([hits("_c", x) for x in terms]) + 3 * _sum([hits("_t", x) for x in terms]) + 2 * _sum([_tag_hits(x) for x in terms])) / len(terms) for q, terms in lists.items()}
    each = F.explode(F.array(*[F.struct(F.lit(q).alias("query"), F.least(c, F.lit(1.0)).alias("score")) for q, c in points.items()]))
    rows = t.select("vault", "path", "ord", each.alias("h")).select("h.query", "vault", "path", "ord", "h.score").where("score > 0")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "ord")
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")


def bulk_search(
    notes: DataFrame, queries: Sequence[str], plain: Column, ranks: DataFrame, now: datetime | str, semantic: Mapping[str, DataFrame] | None = None,
    limit: int = 10, combined: bool = True, threshold: float = 0.0, weights: Weights = Weights(),
) -> DataFrame:
    """Hybrid search of several queries: (query, vault, path, ord, score); combined, the best limit * queries of all.

    ``semantic`` has the semantic hits (vault, path, score) by query.
    """
    hits_of = semantic or {}
    keep = bulk_hits(notes, queries, plain, 100).select("query", "vault", "path")
    for q, near in hits_of.items():
        keep = keep.unionByName(near.select(F.lit(q).alias("query"), "vault", "path")) if near is not None and q.strip() else keep
    # the candidates of all queries, few rows each, in one table
    rows = cut(notes.select("vault", "path", "ord", "tags", "last_modified").join(keep.distinct(), ["vault", "path"]), "bulk-candidates")
    out = None
    for q in queries:
        if q.strip():
            found = relevance(rows.where(F.col("query") == q), q, ranks, now, weights, hits_of.get(q)).where(F.col("score") >= threshold).orderBy(F.desc("score"), "ord").limit(limit)
        else:
            found = search(notes, q, plain, ranks, now, limit=limit, threshold=threshold, weights=weights)
        part = found.select(F.lit(q).alias("query"), "vault", "path", "ord", "score")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return bulk_hits(notes, [], plain, limit)
    return out.orderBy(F.desc("score"), "query", "ord").limit(limit * len(queries)) if combined else out


def bulk_text_search(notes: DataFrame, queries: Sequence[str], plain: Column, limit: int = 10, combined: bool = True) -> DataFrame:
    """As :func:`bulk_search`, with the scores of the text search alone."""
    out = bulk_hits(notes, queries, plain, limit)
    return out.orderBy(F.desc("score"), "query", "ord").limit(limit * len(queries)) if combined else out
