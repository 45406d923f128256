"""Queries of text, vector and hybrid search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.functions import vectors as V
from notemill.functions.keys import valid_vector
from notemill.functions.text import plain_text
from notemill.operators import links as L
from notemill.operators import search as S
from notemill.operators.embeddings import best_chunks
from notemill.operators.notes import substring_search
from notemill.operators.tags import note_tags
from notemill.plans.note_queries import EDGES, LIVE, NOTE_TAGS, ORACLES as _NOTE_SQL, PLAIN, base
from notemill.session import cut
from notemill.sources.tables import table

QUERY, NOW = "garden coffee work", "2026-01-01 00:00:00"
_BULK = ["garden", "coffee market", "zzz"]
_FILTERS = S.Filters(tags=["inbox"], paths=["daily/", "^notes/"], start="2024-03-01", end="2025-12-31")


#: Whose vectors, and how near a note's vector must be to the query's to make it a candidate.
_MODEL, _NEAR = "mini-64", 0.3


def _plain():
    return plain_text("content")


def _ranks(notes: DataFrame) -> DataFrame:
    edges = cut(L.link_edges(notes), "edges")
    return L.pagerank(L.link_nodes(notes, edges), edges)


def text_search(spark: SparkSession, folder: str) -> DataFrame:
    return S.text_search(base(spark, folder), QUERY, _plain(), 100).withColumn("score", F.round("score", 6))


def text_search_case(spark: SparkSession, folder: str) -> DataFrame:
    return S.text_search(base(spark, folder), "Garden Coffee", _plain(), 20, case_sensitive=True, per_vault=True).withColumn("score", F.round("score", 6))


def text_matches(spark: SparkSession, folder: str) -> DataFrame:
    return S.matches(base(spark, folder), QUERY, _plain()).select("ord", "type", "text", "context", "position")


def find_notes(spark: SparkSession, folder: str) -> DataFrame:
    return substring_search(base(spark, folder), "Garden", _plain()).select("vault", "path", "ord")


def search_filtered(spark: SparkSession, folder: str) -> DataFrame:
    notes = base(spark, folder)
    return S.filtered(notes, _FILTERS, note_tags(notes)).select("vault", "path", "ord")


def relevance_parts(spark: SparkSession, folder: str) -> DataFrame:
    notes = base(spark, folder)
    out = S.relevance(notes, QUERY, _ranks(notes), NOW)
    return out.select("vault", "path", "ord", *[F.round(c, 6).alias(c) for c in ("semantic", "tags", "recency", "backlinks", "path_relevance", "score")])


def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    notes = base(spark, folder)
    return S.search(notes, QUERY, _plain(), _ranks(notes), NOW, limit=20).select("vault", "path", "ord", F.round("score", 6).alias("score"))


def hybrid_search_semantic(spark: SparkSession, folder: str) -> DataFrame:
    """hybrid_search with vectors: the first valid vector of one model stands for the query's, its near notes are candidates too."""
    notes = base(spark, folder)
    v = table(spark, folder, "chunk_vectors").where((F.col("model") == _MODEL) & valid_vector("vec", "dimension") & (F.col("dimension") == 64)).dropDuplicates(["vec_id"])
    q = v.orderBy("vec_id").select("vec").first()["vec"]
    of = notes.select("vault", "path", "ord").join(v.select(F.col("note_id").alias("ord"), F.col("vec").alias("embedding")), "ord")
    near = best_chunks(of, q).where(F.col("score") >= _NEAR)
    out = S.search(notes, QUERY, _plain(), _ranks(notes), NOW, semantic=near, limit=20)
    return out.select("vault", "path", "ord", F.round("semantic", 5).alias("semantic"), F.round("score", 5).alias("score"))


def bulk_search(spark: SparkSession, folder: str) -> DataFrame:
    """The text part of the search of several queries."""
    return S.bulk_text_search(base(spark, folder), _BULK, _plain(), 10).select("query", "vault", "path", "ord", F.round("score", 6).alias("score"))


def bulk_search_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    notes = base(spark, folder)
    ranks = _ranks(notes)
    return S.bulk_search(notes, _BULK, _plain(), ranks, NOW, limit=10).select("query", "vault", "path", "ord", F.round("score", 6).alias("score"))


def _embeddings(spark: SparkSession, folder: str) -> tuple[DataFrame, list[float]]:
    """Vectors with their label as the note, and the first vector as the query."""
    e = table(spark, folder, "embeddings")
    return e, e.where("vec_id = 0").first()["embedding"]


def semantic_search(spark: SparkSession, folder: str) -> DataFrame:
    e, q = _embeddings(spark, folder)
    return S.semantic_search(e.select(F.col("label").cast("string").alias("path"), "embedding"), q, threshold=0.0).withColumn("score", F.round("score", 5))


def most_similar(spark: SparkSession, folder: str) -> DataFrame:
    e, q = _embeddings(spark, folder)
    return S.most_similar(q, e.select(F.col("vec_id").alias("id"), "embedding"), threshold=0.1, limit=10).withColumn("similarity", F.round("similarity", 5))


def embedding_check(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "chunk_vectors").dropDuplicates(["vec_id"])
    return v.select("vec_id", V.is_valid("vec").alias("valid"), F.when(V.is_valid("vec"), F.round(V.norm("vec"), 5)).alias("length"))


def embedding_normalized(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    return e.select("vec_id", F.posexplode(V.normalized("embedding")).alias("ix", "x")).select("vec_id", "ix", (F.round("x", 5) + F.lit(0.0)).alias("x"))  # no negative zeros


QUERIES = {
    f.__name__: f
    for f in (text_search, text_search_case, text_matches, find_notes, search_filtered, relevance_parts, hybrid_search, hybrid_search_semantic, bulk_search, bulk_search_hybrid, semantic_search, most_similar, embedding_check, embedding_normalized)
}


def _n(text: str, term: str) -> str:
    return f"((length({text}) - length(replace({text}, '{term}', ''))) // {len(term)})"


def _tag(term: str, low: bool = True) -> str:
    t = "lower(t)" if low else "t"
    return f"len(list_filter(coalesce(tags, []::VARCHAR[]), lambda t: coalesce(contains({t}, '{term}'), false)))"


def _text_sql(query: str, low: bool = True) -> str:
    terms = query.lower().split() if low else query.split()
    c, t = ("lower(p)", "lower(coalesce(title, ''))") if low else ("p", "coalesce(title, '')")
    parts = [" + ".join(_n(c, x) for x in terms), " + ".join(_n(t, x) for x in terms), " + ".join(_tag(x, low) for x in terms)]
    return f"""hits AS (SELECT vault, path, ord, {parts[0]} AS content_hits, {parts[1]} AS title_hits, {parts[2]} AS tag_hits FROM (SELECT *, {PLAIN} AS p FROM titled)),
scored AS (SELECT *, round(least(1.0::DOUBLE, (content_hits + 3 * title_hits + 2 * tag_hits) / {len(terms)}), 6) AS score FROM hits WHERE content_hits + title_hits + tag_hits > 0)"""


def _bulk_sql() -> str:
    out = []
    for i, q in enumerate(("garden", "coffee market", "zzz")):
        s = _text_sql(q).replace("hits AS", f"hits{i} AS").replace("scored AS", f"scored{i} AS").replace("FROM hits ", f"FROM hits{i} ")
        out.append(s + f", best{i} AS (SELECT '{q}' AS query, vault, path, ord, score FROM scored{i} ORDER BY score DESC, ord LIMIT 10)")
    return LIVE + ", " + ", ".join(out) + "SELECT * FROM (SELECT * FROM best0 UNION ALL SELECT * FROM best1 UNION ALL SELECT * FROM best2) ORDER BY score DESC, query, ord LIMIT 30"


_TERMS = QUERY.split()
_RELEVANCE = f"""rel AS (SELECT vault, path, ord, 0.0::DOUBLE AS semantic, CASE WHEN coalesce(len(tags), 0) = 0 THEN 0 ELSE least(1.0::DOUBLE, ({" + ".join(_tag(t) for t in _TERMS)}) / 3) END AS tags,
  greatest(0, 1 - (epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_modified)) / 86400000000.0::DOUBLE / 365) AS recency,
  CASE WHEN contains(lower(path), '{QUERY}') THEN 1.0::DOUBLE ELSE ({" + ".join(f"CAST(contains(lower(path), '{t}') AS INTEGER)" for t in _TERMS)}) / 3 END AS path_relevance,
  lower(regexp_replace(regexp_replace(replace(path, '\\', '/'), '/+', '/', 'g'), '/$', '')) AS node FROM live)"""
_PR = _NOTE_SQL["pagerank"].replace("round(r, 9) AS rank", "r AS rank")
_PR_WITH, _PR_SELECT = _PR.rsplit("\nSELECT vault, node, r", 1)
_FULL = _PR_WITH + f", ranks AS (SELECT vault, node, r{_PR_SELECT}), {_RELEVANCE}, full_score AS (SELECT rel.*, coalesce(rank, 0) AS backlinks, tags * 0.3::DOUBLE + recency * 0.2::DOUBLE + coalesce(rank, 0) * 0.1::DOUBLE AS score FROM rel LEFT JOIN ranks r ON r.vault = rel.vault AND r.node = rel.node)"


def _bulk_hybrid_sql() -> str:
    """The text candidates of each query, scored with their tags, recency and PageRank as in hybrid_search."""
    out = [_FULL]
    for i, q in enumerate(_BULK):
        s = _text_sql(q).replace("hits AS", f"hits{i} AS").replace("scored AS", f"scored{i} AS").replace("FROM hits ", f"FROM hits{i} ")
        tag = f"CASE WHEN coalesce(len(l.tags), 0) = 0 THEN 0 ELSE least(1.0::DOUBLE, ({' + '.join(_tag(t).replace('coalesce(tags,', 'coalesce(l.tags,') for t in q.split())}) / {len(q.split())}) END"
        score = f"{tag} * 0.3::DOUBLE + f.recency * 0.2::DOUBLE + f.backlinks * 0.1::DOUBLE"
        out.append(s + f""", keep{i} AS (SELECT vault, path FROM scored{i} ORDER BY score DESC, ord LIMIT 100),
best{i} AS (SELECT '{q}' AS query, f.vault, f.path, f.ord, {score} AS score FROM full_score f JOIN keep{i} k ON k.vault = f.vault AND k.path = f.path JOIN live l ON l.ord = f.ord ORDER BY score DESC, f.ord LIMIT 10)""")
    return ", ".join(out) + " SELECT query, vault, path, ord, round(score, 6) AS score FROM (SELECT * FROM best0 UNION ALL SELECT * FROM best1 UNION ALL SELECT * FROM best2) ORDER BY score DESC, query, ord LIMIT 30"


ORACLES = {
    "text_search": LIVE + ", " + _text_sql(QUERY) + "SELECT vault, path, ord, content_hits, title_hits, tag_hits, score FROM scored ORDER BY score DESC, ord LIMIT 100",
    "text_search_case": LIVE + ", " + _text_sql("Garden Coffee", False) + "SELECT vault, path, ord, content_hits, title_hits, tag_hits, score FROM scored QUALIFY row_number() OVER (PARTITION BY vault ORDER BY score DESC, ord) <= 20",
    "text_matches": LIVE
    + rf""", src AS (SELECT ord, 'content' AS type, {PLAIN} AS x FROM live UNION ALL SELECT ord, 'title', title FROM titled WHERE title IS NOT NULL),
q AS (SELECT ord, type, x, unnest({_TERMS!r}) AS text FROM src),
parts AS (SELECT ord, type, x, text, string_split(lower(x), text) AS parts FROM q),
spots AS (SELECT ord, type, x, text, unnest(list_transform(range(1, len(parts)), lambda i: list_sum(list_transform(parts[1:i], lambda p: length(p))) + (i - 1) * length(text))) AS position FROM parts)
SELECT ord, type, text, substr(x, CAST(greatest(0, position - 50) + 1 AS BIGINT), CAST(least(position, 50) + length(text) + 50 AS BIGINT)) AS context, 
  CAST(position + length(regexp_replace(substr(x, 1, CAST(position AS BIGINT)), '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')) AS INTEGER) AS position FROM spots""",
    "find_notes": LIVE
    + f"SELECT vault, path, ord FROM titled WHERE contains(lower({PLAIN}), 'garden') OR coalesce(contains(lower(title), 'garden'), false) OR {_tag('garden')} > 0",
    "search_filtered": LIVE
    + ", "
    + NOTE_TAGS
    + """SELECT l.vault, l.path, ord FROM live l JOIN note_tags t ON t.vault = l.vault AND t.path = l.path AND t.tag = 'inbox'
WHERE (regexp_matches(l.path, 'daily/', 'i') OR regexp_matches(l.path, '^notes/', 'i')) AND last_modified >= TIMESTAMP '2024-03-01' AND last_modified <= TIMESTAMP '2025-12-31'""",
    "relevance_parts": _FULL + "SELECT vault, path, ord, semantic, round(tags, 6) AS tags, round(recency, 6) AS recency, round(backlinks, 6) AS backlinks, round(path_relevance, 6) AS path_relevance, round(score, 6) AS score FROM full_score",
    "hybrid_search": _FULL
    + ", "
    + _text_sql(QUERY)
    + ", keep AS (SELECT vault, path FROM scored ORDER BY score DESC, ord LIMIT 100) SELECT f.vault, f.path, f.ord, round(f.score, 6) AS score FROM full_score f JOIN keep k ON k.vault = f.vault AND k.path = f.path ORDER BY f.score DESC, f.ord LIMIT 20",
    "hybrid_search_semantic": _FULL
    + ", "
    + _text_sql(QUERY)
    + f""", keep0 AS (SELECT vault, path FROM scored ORDER BY score DESC, ord LIMIT 100),
vec AS (SELECT DISTINCT ON (vec_id) vec_id, note_id, CAST(vec AS DOUBLE[]) AS v FROM chunk_vectors WHERE model = '{_MODEL}' AND dimension = 64 AND vec IS NOT NULL AND len(vec) = 64
  AND NOT list_contains(list_transform(vec, lambda x: isnan(x)), true) AND list_max(list_transform(vec, lambda x: abs(x))) > 0),
q AS (SELECT v AS q FROM vec ORDER BY vec_id LIMIT 1),
near AS (SELECT l.vault, l.path, max(list_cosine_similarity(v, q)) AS s FROM vec JOIN live l ON l.ord = vec.note_id, q GROUP BY 1, 2 HAVING s >= {_NEAR}),
keep AS (SELECT * FROM keep0 UNION SELECT vault, path FROM near),
final AS (SELECT f.vault, f.path, f.ord, coalesce(n.s, 0) AS semantic, coalesce(n.s, 0) * 0.4::DOUBLE + f.score AS score FROM full_score f JOIN keep k ON k.vault = f.vault AND k.path = f.path LEFT JOIN near n ON n.vault = f.vault AND n.path = f.path)
SELECT vault, path, ord, round(semantic, 5) AS semantic, round(score, 5) AS score FROM final ORDER BY final.score DESC, ord LIMIT 20""",
    "bulk_search": _bulk_sql(),
    "bulk_search_hybrid": _bulk_hybrid_sql(),
    "semantic_search": """WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)
SELECT CAST(label AS VARCHAR) AS path, round(max(greatest(0, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q))), 5) AS score FROM embeddings, q GROUP BY label""",
    "most_similar": """WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id AS id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS s FROM embeddings, q)
SELECT id, round(s, 5) AS similarity FROM s WHERE s >= 0.1 ORDER BY s DESC, id LIMIT 10""",
    "embedding_check": """WITH v AS (SELECT DISTINCT ON (vec_id) vec_id, CAST(vec AS DOUBLE[]) AS vec FROM chunk_vectors),
c AS (SELECT vec_id, vec, coalesce(len(vec) > 0 AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0, false) AS valid FROM v)
SELECT vec_id, valid, CASE WHEN valid THEN round(sqrt(list_sum(list_transform(vec, lambda x: x * x))), 5) END AS length FROM c""",
    "embedding_normalized": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS l FROM e)
SELECT vec_id, CAST(unnest(range(len(v))) AS INTEGER) AS ix, round(unnest(list_transform(v, lambda x: CASE WHEN l = 0 THEN x ELSE x / l END)), 5) + 0.0::DOUBLE AS x FROM n""",
}
