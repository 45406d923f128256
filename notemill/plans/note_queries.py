"""Queries over the notes table: extraction, tags, links and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.functions import text as T
from notemill.operators import links as L
from notemill.operators import tags as G
from notemill.operators.listing import file_metadata, listed, recent, vault_health
from notemill.operators.notes import index_stats, notes_table
from notemill.session import cut
from notemill.sources.tables import table


def base(spark: SparkSession, folder: str) -> DataFrame:
    return notes_table(table(spark, folder, "notes"))


def frontmatter_tags() -> F.Column:
    return F.from_json(F.try_element_at("frontmatter", F.lit("tags")), "array<string>")


#: The live notes, as notes_table has them.
LIVE = """
WITH cur AS (SELECT note_id, max(rev) AS rev FROM notes GROUP BY note_id),
live AS (SELECT n.note_id AS ord, any_value(vault) AS vault, any_value(path) AS path, any_value(last_modified) AS last_modified, any_value(size) AS size, any_value(frontmatter) AS frontmatter,
  any_value(content) AS content, any_value(tags) AS tags, any_value(links) AS links FROM notes n JOIN cur c ON n.note_id = c.note_id AND n.rev = c.rev WHERE n.deleted_at IS NULL GROUP BY n.note_id),
titled AS (SELECT *, CASE WHEN json_valid(frontmatter['title']) THEN json_extract_string(frontmatter['title'], '$') END AS title FROM live)
"""
# The default patterns and replacements once more, as SQL literals.
PLAIN = "content"
for _p, _r in (
    (r"!\[[^\]]*\]\([^\)]+\)", ""), (r"\[[^\]]+\]\([^\)]+\)", "$1"), (r"\[\[([^\]]+)\]\]", r"\1"), (r"#{1,6}\s+", ""), (r"\*\*([^*]+)\*\*", r"\1"), (r"\*([^*]+)\*", r"\1"),
    (r"`([^`]+)`", r"\1"), (r"```[\s\S]*?```", ""), (r"---[\s\S]*?---", ""),
):
    PLAIN = f"regexp_replace({PLAIN}, '{_p}', '{_r}', 'g')"
PLAIN = f"regexp_replace(regexp_replace({PLAIN}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"
SLASH = "lower(regexp_replace(regexp_replace(replace({0}, '\\', '/'), '/+', '/', 'g'), '/$', ''))"
NOTE_TAGS = r"""note_tags AS (SELECT DISTINCT vault, path, last_modified AS seen, tag FROM (SELECT vault, path, last_modified, regexp_replace(regexp_replace(trim(lower(t)), '^#', ''), '\s+', '-', 'g') AS tag
  FROM (SELECT vault, path, last_modified, unnest(tags) AS t FROM live)) WHERE tag <> '')
"""
_FOLD = """array_to_string(list_reduce(list_transform(string_split(t, '/'), lambda p: [p]), lambda acc, p: CASE WHEN p[1] IN ('', '.') THEN acc WHEN p[1] = '..' THEN acc[1:greatest(len(acc) - 1, 0)]
  ELSE list_concat(acc, p) END, list_filter(string_split(regexp_replace(src, '/?[^/]*$', ''), '/'), lambda p: p <> '')), '/')"""
EDGES = f"""raw_edges AS (SELECT vault, {SLASH.format("path")} AS src, ord, unnest(links) AS l, unnest(range(len(links))) AS pos FROM live),
edges AS (SELECT vault, src, CAST(pos AS INTEGER) AS pos, t AS target_raw, {SLASH.format(f"CASE WHEN starts_with(t, '/') THEN t WHEN starts_with(t, './') OR starts_with(t, '../') THEN {_FOLD} ELSE regexp_replace(src, '[^/]*$', '') || t END")} AS target,
  l.text AS text, l.line AS line, l.type AS type FROM (SELECT *, l.target AS t FROM raw_edges) WHERE t IS NOT NULL),
real AS (SELECT vault, {SLASH.format("path")} AS node, min(ord) AS ord FROM live GROUP BY 1, 2),
nodes AS (SELECT vault, node, max(is_real) AS is_real FROM (SELECT vault, node, true AS is_real FROM real UNION ALL SELECT vault, target, false FROM edges) GROUP BY 1, 2),
degree AS (SELECT n.vault, n.node, n.is_real, coalesce(o.c, 0) AS outgoing, coalesce(i.c, 0) AS incoming FROM nodes n
  LEFT JOIN (SELECT vault, src AS node, count(*) AS c FROM edges GROUP BY 1, 2) o ON o.vault = n.vault AND o.node = n.node
  LEFT JOIN (SELECT vault, target AS node, count(*) AS c FROM edges GROUP BY 1, 2) i ON i.vault = n.vault AND i.node = n.node),
broken AS (SELECT e.* FROM edges e LEFT JOIN real r ON r.vault = e.vault AND r.node = e.target WHERE r.node IS NULL),
both_ways AS (SELECT vault, src AS a, target AS b FROM edges UNION SELECT vault, target, src FROM edges)
"""


def _tags(spark: SparkSession, folder: str) -> DataFrame:
    return G.note_tags(base(spark, folder))


def _graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    notes = base(spark, folder)
    # read several times by what follows
    edges = cut(L.link_edges(notes), "edges")
    return notes, edges, L.link_nodes(notes, edges)


def links_extract(spark: SparkSession, folder: str) -> DataFrame:
    return base(spark, folder).select("ord", F.posexplode(T.links_of("content")).alias("pos", "l")).select("ord", "pos", "l.target", "l.text", "l.type", "l.line")


def tags_extract(spark: SparkSession, folder: str) -> DataFrame:
    return base(spark, folder).select("ord", F.posexplode(T.tags_of("content", frontmatter_tags())).alias("pos", "tag"))


def headings_extract(spark: SparkSession, folder: str) -> DataFrame:
    return base(spark, folder).select("ord", F.explode(T.headings_of("content")).alias("h")).select("ord", "h.level", "h.text", "h.line")


def plain_texts(spark: SparkSession, folder: str) -> DataFrame:
    p = T.plain_text("content")
    return base(spark, folder).select("ord", F.md5(p).alias("digest"), F.length(p).alias("chars"), T.estimated_tokens(p).alias("tokens"))


def content_hashes(spark: SparkSession, folder: str) -> DataFrame:
    return base(spark, folder).select("ord", T.content_hash("content").alias("content_hash"))


def chunk_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of the plain text, as the index makes them."""
    return base(spark, folder).select("ord", F.posexplode(T.chunked(T.plain_text("content"))).alias("chunk_ix", "chunk"))


def wikilink_paths(spark: SparkSession, folder: str) -> DataFrame:
    rows = base(spark, folder).select("ord", "path", F.posexplode("links").alias("pos", "l")).where("l.type = 'wikilink' AND l.target IS NOT NULL")
    return rows.select("ord", "pos", T.wikilink_path(F.col("l.target"), "path").alias("to_path"))


def tag_stats(spark: SparkSession, folder: str) -> DataFrame:
    return G.tag_stats(_tags(spark, folder))


def tag_cooccurrence_topk(spark: SparkSession, folder: str) -> DataFrame:
    return G.top_cooccurring(_tags(spark, folder), 10)


_AND, _OR = ["#Project", "todo"], ["Place/ Nowhere", "inbox", "daily"]


def files_by_tags_and(spark: SparkSession, folder: str) -> DataFrame:
    return G.files_by_tags(_tags(spark, folder), _AND, "and")


def files_by_tags_or(spark: SparkSession, folder: str) -> DataFrame:
    return G.files_by_tags(_tags(spark, folder), _OR, "or")


def tag_children(spark: SparkSession, folder: str) -> DataFrame:
    return G.child_tags(_tags(spark, folder))


def tag_ancestors(spark: SparkSession, folder: str) -> DataFrame:
    return _tags(spark, folder).select("vault", "tag").distinct().select("vault", "tag", F.explode(G.ancestors("tag")).alias("ancestor"))


_HAVE = ["Project", "work/log", "#inbox", "topic/a/b"]


def tag_suggestions(spark: SparkSession, folder: str) -> DataFrame:
    return G.suggested_tags(_tags(spark, folder), _HAVE, 10)


def recent_tags(spark: SparkSession, folder: str) -> DataFrame:
    return tag_stats(spark, folder).orderBy(F.desc("last_seen"), "vault", "tag").limit(100).select("vault", "tag", "file_count", "last_seen")


def _bulk(operation: str, tags: list[str], target: list[str] | None):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        out = G.bulk_tags(base(spark, folder), operation, tags, target)
        j = lambda c: F.array_join(F.transform(c, lambda t: F.coalesce(t, F.lit("~"))), "|")
        return out.select("vault", "path", j("old_tags").alias("old_tags"), j("new_tags").alias("new_tags"))

    return run


def backlinks_of_home(spark: SparkSession, folder: str) -> DataFrame:
    return L.backlinks(_graph(spark, folder)[1], "home.md")


def broken_links(spark: SparkSession, folder: str) -> DataFrame:
    _, edges, nodes = _graph(spark, folder)
    return L.broken_links(edges, nodes).select("vault", "src", "pos", "target_raw", "target", "text", "line", "type")


def link_suggestions(spark: SparkSession, folder: str) -> DataFrame:
    notes, edges, nodes = _graph(spark, folder)
    return L.link_suggestions(L.broken_links(edges, nodes), notes, 5)


def orphans(spark: SparkSession, folder: str) -> DataFrame:
    _, edges, nodes = _graph(spark, folder)
    return L.orphaned(L.degrees(nodes, edges))


def hubs(spark: SparkSession, folder: str) -> DataFrame:
    _, edges, nodes = _graph(spark, folder)
    return L.ranked(L.degrees(nodes, edges), "outgoing", 10)


def authorities(spark: SparkSession, folder: str) -> DataFrame:
    _, edges, nodes = _graph(spark, folder)
    return L.ranked(L.degrees(nodes, edges), "incoming", 10)


def link_stats(spark: SparkSession, folder: str) -> DataFrame:
    _, edges, nodes = _graph(spark, folder)
    return L.link_stats(edges, L.degrees(nodes, edges), L.broken_links(edges, nodes))


def _starts(notes: DataFrame) -> DataFrame:
    """In each vault, the note of the lowest order that is no home note."""
    return L.real_nodes(notes).groupBy("vault").agg(F.min_by("node", "ord").alias("node"))


def related_2hop(spark: SparkSession, folder: str) -> DataFrame:
    notes, edges, _ = _graph(spark, folder)
    return L.related(edges, _starts(notes), 2)


def pagerank(spark: SparkSession, folder: str) -> DataFrame:
    _, edges, nodes = _graph(spark, folder)
    return L.pagerank(nodes, edges).select("vault", "node", F.round("rank", 9).alias("rank"))


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    return listed(base(spark, folder), pattern="daily/", sort_by="size", limit=50)


def recent_files(spark: SparkSession, folder: str) -> DataFrame:
    return recent(base(spark, folder), by="created", limit=20, since="2024-06-01")


def files_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return file_metadata(base(spark, folder))


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(vault, path, embedding, ix): the vectors of live notes' chunks, each once."""
    v = table(spark, folder, "chunk_vectors").dropDuplicates(["vec_id"]).select(F.col("note_id").alias("ord"), "vec_id", "vec", "dimension", "model")
    return base(spark, folder).select("ord", "vault", "path").join(v, "ord")


def vault_stats(spark: SparkSession, folder: str) -> DataFrame:
    return index_stats(base(spark, folder), _vectors(spark, folder))


def health(spark: SparkSession, folder: str) -> DataFrame:
    notes, edges, nodes = _graph(spark, folder)
    stats = L.link_stats(edges, L.degrees(nodes, edges), L.broken_links(edges, nodes))
    out = vault_health(notes, stats, G.tag_stats(G.note_tags(notes)), index_stats(notes, _vectors(spark, folder)))
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


QUERIES = {
    f.__name__: f
    for f in (
        links_extract, tags_extract, headings_extract, plain_texts, content_hashes, chunk_texts, wikilink_paths, tag_stats, tag_cooccurrence_topk, files_by_tags_and, files_by_tags_or, tag_children,
        tag_ancestors, tag_suggestions, recent_tags, backlinks_of_home, broken_links, link_suggestions, orphans, hubs, authorities, link_stats, related_2hop, pagerank, list_files, recent_files,
        files_metadata, vault_stats,
    )
} | {
    "vault_health": health,
    "bulk_tag_add": _bulk("add", ["reviewed", "inbox", "reviewed"], None),
    "bulk_tag_remove": _bulk("remove", [], ["inbox", "todo"]),
    "bulk_tag_replace": _bulk("replace", ["archive"], ["inbox"]),
}

_JOIN = "array_to_string(list_transform({0}, lambda t: coalesce(t, '~')), '|')"
_OLD = "coalesce(tags, []::VARCHAR[])"
_VECTORS = "vec AS (SELECT DISTINCT ON (vec_id) vec_id, note_id FROM chunk_vectors), of_live AS (SELECT l.vault, l.path FROM vec v JOIN live l ON l.ord = v.note_id)"
_STATS = """link_stats AS (SELECT d.vault, count(*) AS nodes, count(*) FILTER (is_real) AS real_nodes, CAST(sum(outgoing) AS BIGINT) AS links, count(*) FILTER (incoming = 0) AS orphans,
  coalesce(any_value(b.c), 0) AS broken FROM degree d LEFT JOIN (SELECT vault, count(*) AS c FROM broken GROUP BY 1) b ON b.vault = d.vault GROUP BY d.vault)"""
_FM_TAGS = "CASE WHEN json_valid(frontmatter['tags']) AND json_type(frontmatter['tags']) = 'ARRAY' THEN list_transform(json_extract_string(frontmatter['tags'], '$[*]'), lambda t: regexp_replace(t, '^#', '')) ELSE []::VARCHAR[] END"
#: Plain texts without headings: paragraphs one after the other, a new chunk where the next one would exceed 1000 units.
_CHUNKED = (
    LIVE.replace("WITH cur", "WITH RECURSIVE cur")
    + f""", parts AS (SELECT ord, list_filter(regexp_split_to_array({PLAIN}, '\\n\\s*\\n'), lambda p: p <> '') AS ps FROM live),
para AS MATERIALIZED (SELECT ord, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM parts), sized AS MATERIALIZED (SELECT *, length(p) + length(regexp_replace(p, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) AS n FROM para),
packed AS (SELECT ord, i, p, 0 AS chunk_ix, n AS held FROM sized WHERE i = 0
  UNION ALL SELECT s.ord, s.i, s.p, CASE WHEN held + n > 1000 THEN chunk_ix + 1 ELSE chunk_ix END, CASE WHEN held + n > 1000 THEN n ELSE held + 2 + n END FROM packed k JOIN sized s ON s.ord = k.ord AND s.i = k.i + 1)
SELECT ord, chunk_ix, regexp_replace(string_agg(p, chr(10) || chr(10) ORDER BY i), '^\\s+|\\s+$', '', 'g') AS chunk FROM packed GROUP BY 1, 2"""
)
ORACLES = {
    "chunk_texts": _CHUNKED,
    "links_extract": LIVE
    + r""", lines AS (SELECT ord, unnest(string_split(content, chr(10))) AS line, unnest(range(len(string_split(content, chr(10))))) + 1 AS n FROM live),
found AS (
  SELECT ord, n, 0 AS kind, unnest(m) AS m, unnest(range(len(m))) AS k, NULL AS u FROM (SELECT ord, n, regexp_extract_all(line, '\[\[([^\]]+)\]\]', 1) AS m FROM lines)
  UNION ALL SELECT ord, n, 1, unnest(m), unnest(range(len(m))), unnest(u) FROM (SELECT ord, n, regexp_extract_all(line, '\[([^\]]+)\]\(([^\)]+\.md)\)', 1) AS m, regexp_extract_all(line, '\[([^\]]+)\]\(([^\)]+\.md)\)', 2) AS u FROM lines))
SELECT ord, CAST(row_number() OVER (PARTITION BY ord ORDER BY n, kind, k) - 1 AS INTEGER) AS pos, CASE kind WHEN 0 THEN trim(split_part(m, '|', 1)) ELSE u END AS target,
  CASE WHEN kind = 1 THEN m WHEN trim(split_part(m, '|', 2)) = '' THEN trim(split_part(m, '|', 1)) ELSE trim(split_part(m, '|', 2)) END AS text,
  CASE kind WHEN 0 THEN 'wikilink' ELSE 'markdown' END AS type, CAST(n AS INTEGER) AS line FROM found""",
    "tags_extract": LIVE
    + f""", fm AS (SELECT ord, {_FM_TAGS} AS f, regexp_extract_all(content, '#([a-zA-Z0-9_/-]+)', 1) AS i FROM live),
inline AS (SELECT ord, tag, min(k) AS k FROM (SELECT ord, f, unnest(i) AS tag, unnest(range(len(i))) AS k FROM fm) WHERE NOT list_contains(f, tag) GROUP BY ord, tag),
every AS (SELECT ord, unnest(f) AS tag, 0 AS kind, unnest(range(len(f))) AS k FROM fm UNION ALL SELECT ord, tag, 1, k FROM inline)
SELECT ord, CAST(row_number() OVER (PARTITION BY ord ORDER BY kind, k) - 1 AS INTEGER) AS pos, tag FROM every""",
    "headings_extract": LIVE
    + r""", lines AS (SELECT ord, unnest(string_split(content, chr(10))) AS line, unnest(range(len(string_split(content, chr(10))))) + 1 AS n FROM live)
SELECT ord, CAST(length(regexp_extract(line, '^(#{1,6})\s+(.+)$', 1)) AS INTEGER) AS level, trim(regexp_extract(line, '^(#{1,6})\s+(.+)$', 2)) AS text, CAST(n AS INTEGER) AS line
FROM lines WHERE regexp_matches(line, '^(#{1,6})\s+(.+)$')""",
    "plain_texts": LIVE
    + f""", plain AS (SELECT ord, {PLAIN} AS p FROM live)
SELECT ord, md5(p) AS digest, CAST(length(p) AS INTEGER) AS chars, CAST(ceil((length(p) + length(regexp_replace(p, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'))) / 4) AS BIGINT) AS tokens FROM plain""",
    "content_hashes": LIVE
    + """, h AS (SELECT ord, list_reduce(list_transform(string_split(content, ''), lambda c: CAST(ord(c) AS BIGINT)), lambda h, c: CASE WHEN c < 65536 THEN (h * 31 + c) & 4294967295
  ELSE ((((h * 31 + 55296 + ((c - 65536) // 1024)) & 4294967295) * 31 + 56320 + ((c - 65536) % 1024)) & 4294967295) END, 0::BIGINT) AS h FROM live)
SELECT ord, lower(to_base(CASE WHEN h >= 2147483648 THEN 4294967296 - h ELSE h END, 36)) AS content_hash FROM h""",
    "wikilink_paths": LIVE
    + r""", l AS (SELECT ord, path, unnest(links) AS l, unnest(range(len(links))) AS pos FROM live),
c AS (SELECT ord, path, pos, trim(split_part(regexp_replace(l.target, '[\[\]]', '', 'g'), '|', 1)) AS c FROM l WHERE l.type = 'wikilink' AND l.target IS NOT NULL)
SELECT ord, CAST(pos AS INTEGER) AS pos, CASE WHEN contains(c, '/') THEN '' ELSE regexp_replace(path, '[^/]*$', '') END || c || CASE WHEN c LIKE '%.md' THEN '' ELSE '.md' END AS to_path FROM c""",
    "tag_stats": LIVE + ", " + NOTE_TAGS + "SELECT vault, tag, count(*) AS file_count, min(seen) AS first_seen, max(seen) AS last_seen, CAST(len(string_split(tag, '/')) AS INTEGER) AS depth FROM note_tags GROUP BY vault, tag",
    "tag_cooccurrence_topk": LIVE
    + ", "
    + NOTE_TAGS
    + """, co AS (SELECT a.vault, a.tag, b.tag AS other, count(*) AS n FROM note_tags a JOIN note_tags b ON a.vault = b.vault AND a.path = b.path AND a.tag <> b.tag GROUP BY 1, 2, 3)
SELECT vault, tag, other, n, CAST(row_number() OVER (PARTITION BY vault, tag ORDER BY n DESC, other) AS INTEGER) AS rank FROM co QUALIFY rank <= 10""",
    "files_by_tags_and": LIVE + ", " + NOTE_TAGS + "SELECT vault, path FROM note_tags WHERE tag IN ('project', 'todo') GROUP BY 1, 2 HAVING count(DISTINCT tag) = 2",
    "files_by_tags_or": LIVE + ", " + NOTE_TAGS + "SELECT DISTINCT vault, path FROM note_tags WHERE tag IN ('place/-nowhere', 'inbox', 'daily')",
    "tag_children": LIVE + ", " + NOTE_TAGS + "SELECT DISTINCT vault, regexp_replace(tag, '/[^/]*$', '') AS parent, tag FROM note_tags WHERE contains(tag, '/')",
    "tag_ancestors": LIVE
    + ", "
    + NOTE_TAGS
    + """, p AS (SELECT DISTINCT vault, tag, string_split(tag, '/') AS parts FROM note_tags)
SELECT vault, tag, array_to_string(parts[1:i], '/') AS ancestor FROM (SELECT vault, tag, parts, unnest(range(1, len(parts))) AS i FROM p)""",
    "tag_suggestions": LIVE
    + ", "
    + NOTE_TAGS
    + """, have AS (SELECT unnest(['project', 'work/log', 'inbox', 'topic/a/b']) AS tag),
co AS (SELECT a.vault, a.tag AS have, b.tag, count(*) AS score FROM note_tags a JOIN have h ON h.tag = a.tag JOIN note_tags b ON a.vault = b.vault AND a.path = b.path AND a.tag <> b.tag GROUP BY 1, 2, 3),
top AS (SELECT * FROM co QUALIFY row_number() OVER (PARTITION BY vault, have ORDER BY score DESC, tag) <= 10),
names AS (SELECT DISTINCT vault, tag FROM note_tags),
every AS (SELECT vault, tag, score, 'co_occurrence' AS reason FROM top WHERE tag NOT IN (SELECT tag FROM have)
  UNION ALL SELECT vault, n.tag, 5, 'hierarchy' FROM names n JOIN (SELECT unnest(['work', 'topic', 'topic/a']) AS tag) u ON u.tag = n.tag
  UNION ALL SELECT vault, n.tag, 3, 'hierarchy' FROM names n JOIN have h ON contains(n.tag, '/') AND regexp_replace(n.tag, '/[^/]*$', '') = h.tag)
SELECT vault, tag, score, reason, CAST(row_number() OVER (PARTITION BY vault ORDER BY score DESC, reason, tag) AS INTEGER) AS rank FROM every QUALIFY rank <= 10""",
    "recent_tags": LIVE + ", " + NOTE_TAGS + "SELECT vault, tag, count(*) AS file_count, max(seen) AS last_seen FROM note_tags GROUP BY vault, tag ORDER BY last_seen DESC, vault, tag LIMIT 100",
    "backlinks_of_home": LIVE
    + ", "
    + EDGES
    + "SELECT vault, 'outgoing' AS direction, target AS other, text, line, type FROM edges WHERE src = 'home.md' UNION ALL SELECT vault, 'incoming', src, text, line, type FROM edges WHERE target = 'home.md'",
    "broken_links": LIVE + ", " + EDGES + "SELECT vault, src, pos, target_raw, target, text, line, type FROM broken",
    "link_suggestions": LIVE
    + ", "
    + EDGES
    + """, t AS (SELECT DISTINCT vault, target_raw FROM broken)
SELECT t.vault, target_raw, node AS suggestion, CAST(row_number() OVER (PARTITION BY t.vault, target_raw ORDER BY ord) AS INTEGER) AS rank
FROM t JOIN real r ON r.vault = t.vault AND (contains(node, lower(target_raw)) OR contains(lower(target_raw), node)) WHERE target_raw <> '' QUALIFY rank <= 5""",
    "orphans": LIVE + ", " + EDGES + "SELECT vault, node, is_real FROM degree WHERE incoming = 0",
    "hubs": LIVE + ", " + EDGES + "SELECT vault, node, outgoing AS n, CAST(row_number() OVER (PARTITION BY vault ORDER BY outgoing DESC, node) AS INTEGER) AS rank FROM degree QUALIFY rank <= 10",
    "authorities": LIVE + ", " + EDGES + "SELECT vault, node, incoming AS n, CAST(row_number() OVER (PARTITION BY vault ORDER BY incoming DESC, node) AS INTEGER) AS rank FROM degree QUALIFY rank <= 10",
    "link_stats": LIVE + ", " + EDGES + ", " + _STATS + " SELECT * FROM link_stats",
    "related_2hop": LIVE
    + ", "
    + EDGES
    + """, s AS (SELECT vault, arg_min(node, ord) AS start FROM real GROUP BY vault),
one AS (SELECT DISTINCT s.vault, s.start, b.b AS node FROM s JOIN both_ways b ON b.vault = s.vault AND b.a = s.start WHERE b.b <> s.start),
two AS (SELECT DISTINCT o.vault, o.start, b.b AS node FROM one o JOIN both_ways b ON b.vault = o.vault AND b.a = o.node WHERE b.b <> o.start)
SELECT vault, start, node, CAST(min(d) AS INTEGER) AS distance FROM (SELECT *, 1 AS d FROM one UNION ALL SELECT *, 2 FROM two) GROUP BY 1, 2, 3""",
    "pagerank": LIVE.replace("WITH cur", "WITH RECURSIVE cur")
    + ", "
    + EDGES
    + """, cnt AS (SELECT vault, count(*) AS c FROM nodes GROUP BY vault), outs AS (SELECT vault, src, count(*) AS o FROM edges GROUP BY 1, 2),
w AS MATERIALIZED (SELECT e.vault, e.src, e.target, o FROM edges e JOIN outs o ON o.vault = e.vault AND o.src = e.src), nn AS MATERIALIZED (SELECT n.vault, n.node, c FROM nodes n JOIN cnt ON cnt.vault = n.vault),
pr AS (SELECT 0 AS it, vault, node, 1.0::DOUBLE / c AS r FROM nn
  UNION ALL SELECT it, vault, node, sum(v) FROM (SELECT it + 1 AS it, vault, node, x.v FROM (
    SELECT p.it, p.vault, p.node, 0.15::DOUBLE / nn.c AS v FROM pr p JOIN nn ON nn.vault = p.vault AND nn.node = p.node WHERE p.it < 20
    UNION ALL SELECT p.it, p.vault, w.target, 0.85::DOUBLE * p.r / w.o FROM pr p JOIN w ON w.vault = p.vault AND w.src = p.node WHERE p.it < 20) x) GROUP BY it, vault, node)
SELECT vault, node, round(r, 9) AS rank FROM pr WHERE it = 20""",
    "list_files": LIVE + "SELECT vault, path, size, last_modified AS modified FROM live WHERE regexp_matches(path, 'daily/', 'i') ORDER BY size DESC NULLS LAST, ord LIMIT 50",
    "recent_files": LIVE
    + """, c AS (SELECT *, coalesce(CASE WHEN json_valid(frontmatter['created']) THEN try_cast(replace(json_extract_string(frontmatter['created'], '$'), 'Z', '') AS TIMESTAMP) END, last_modified) AS made FROM titled)
SELECT vault, path, coalesce(nullif(title, ''), path) AS title, last_modified AS modified, made AS created, size FROM c WHERE made >= TIMESTAMP '2024-06-01' ORDER BY made DESC, ord LIMIT 20""",
    "files_metadata": LIVE + "SELECT vault, path, title, size, last_modified AS modified, CAST(coalesce(len(tags), 0) AS INTEGER) AS tags, CAST(coalesce(len(links), 0) AS INTEGER) AS links FROM titled",
    "vault_stats": LIVE
    + ", "
    + _VECTORS
    + """ SELECT l.vault, count(*) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS total_size, max(last_modified) AS last_modified,
  coalesce((SELECT count(*) FROM of_live o WHERE o.vault = l.vault), 0) AS embeddings FROM live l GROUP BY l.vault""",
    "vault_health": LIVE
    + ", "
    + EDGES
    + ", "
    + _STATS
    + ", "
    + NOTE_TAGS
    + ", "
    + _VECTORS
    + """, n AS (SELECT vault, count(*) AS files, count(*) FILTER (coalesce(len(tags), 0) = 0) AS untagged FROM live GROUP BY 1), t AS (SELECT vault, count(DISTINCT tag) AS tags, count(*) AS uses FROM note_tags GROUP BY 1),
e AS (SELECT vault, count(*) AS embeddings FROM of_live GROUP BY 1),
s AS (SELECT n.vault, files, untagged, links, broken, orphans, coalesce(tags, 0) AS tags, coalesce(uses, 0) AS uses, coalesce(embeddings, 0) AS embeddings,
  greatest(0, 100 - broken / greatest(1, links) * 100) AS connectivity, greatest(0, 100 - orphans / greatest(1, files) * 100) AS organization,
  least(100, coalesce(embeddings, 0) / files * 100) AS completeness, 100.0::DOUBLE AS consistency
  FROM n JOIN link_stats l ON l.vault = n.vault LEFT JOIN t ON t.vault = n.vault LEFT JOIN e ON e.vault = n.vault)
SELECT vault, files, untagged, links, broken, orphans, tags, embeddings, round(uses / files, 6) AS tags_per_file, round(connectivity, 6) AS connectivity, round(organization, 6) AS organization, round(completeness, 6) AS completeness,
  round(consistency, 6) AS consistency, CASE WHEN (connectivity + organization + completeness + consistency) / 4 >= 80 THEN 'excellent' WHEN (connectivity + organization + completeness + consistency) / 4 >= 60 THEN 'good'
  WHEN (connectivity + organization + completeness + consistency) / 4 >= 40 THEN 'fair' ELSE 'poor' END AS overall,
  array_to_string(list_filter([CASE WHEN broken > 0 THEN 'broken_links:' || CASE WHEN broken > links * 0.1 THEN 'high' ELSE 'medium' END END,
    CASE WHEN orphans > 0 THEN 'orphaned_files:' || CASE WHEN orphans > files * 0.2 THEN 'high' ELSE 'low' END END,
    CASE WHEN untagged > 0 THEN 'untagged_files:' || CASE WHEN untagged > files * 0.3 THEN 'medium' ELSE 'low' END END], lambda x: x IS NOT NULL), ' ') AS issues,
  array_to_string(list_filter([CASE WHEN broken > 0 THEN 'fix_broken_links' END, CASE WHEN orphans > 5 THEN 'connect_orphaned_files' END, CASE WHEN untagged > files * 0.2 THEN 'add_tags' END,
    CASE WHEN embeddings < files * 0.8 THEN 'build_embeddings' END], lambda x: x IS NOT NULL), ' ') AS recommendations FROM s""",
    "bulk_tag_add": LIVE
    + f""", b AS (SELECT vault, path, {_OLD} AS o FROM live), n AS (SELECT vault, path, o, list_concat(o, list_filter(['reviewed', 'inbox'], lambda t: NOT list_contains(o, t))) AS n FROM b)
SELECT vault, path, {_JOIN.format("o")} AS old_tags, {_JOIN.format("n")} AS new_tags FROM n WHERE len(n) <> len(o)""",
    "bulk_tag_remove": LIVE
    + f""", b AS (SELECT vault, path, {_OLD} AS o FROM live), n AS (SELECT vault, path, o, list_filter(o, lambda t: coalesce(t NOT IN ('inbox', 'todo'), true)) AS n FROM b)
SELECT vault, path, {_JOIN.format("o")} AS old_tags, {_JOIN.format("n")} AS new_tags FROM n WHERE len(n) <> len(o)""",
    "bulk_tag_replace": LIVE
    + f""", b AS (SELECT vault, path, {_OLD} AS o FROM live), n AS (SELECT vault, path, o, list_concat(list_filter(o, lambda t: coalesce(t <> 'inbox', true)), ['archive']) AS n FROM b)
SELECT vault, path, {_JOIN.format("o")} AS old_tags, {_JOIN.format("n")} AS new_tags FROM n""",
}
