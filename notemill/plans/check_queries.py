"""Queries of validation, templates, embeddings and change feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.operators import templates as P
from notemill.operators import validation as C
from notemill.operators.embeddings import HashProvider, embedded
from notemill.plans.note_queries import LIVE, PLAIN, base
from notemill.sources.tables import table
from notemill.streaming.changes import coalesced

_RULES = [C.Rule(n) for n in C.BUILT_IN]
TEMPLATES = [
    P.Template(r"^daily/.*\.md$", ["title", "date"], {"title": {"type": "string"}, "tags": {"type": "array"}, "aliases": {"type": "array"}}, "# {{title}}\n"),
    P.Template(r"projects/", ["title", "created"], {"created": {"type": "string"}, "priority": {"type": "integer", "minimum": 1, "maximum": 3}}),
]


def validation_findings(spark: SparkSession, folder: str) -> DataFrame:
    return C.findings(base(spark, folder), _RULES).select("vault", "path", "rule", "severity", "message", "line", "suggestion")


def validation_rollup(spark: SparkSession, folder: str) -> DataFrame:
    notes = base(spark, folder)
    return C.rollup(notes, C.findings(notes, _RULES))


def missing_fields(spark: SparkSession, folder: str) -> DataFrame:
    return C.missing_fields(base(spark, folder), ["title", "created", "status"])


def template_match(spark: SparkSession, folder: str) -> DataFrame:
    return P.matched(base(spark, folder).select("vault", "path"), TEMPLATES)


def template_errors(spark: SparkSession, folder: str) -> DataFrame:
    return P.template_errors(base(spark, folder), TEMPLATES)


def change_coalesce(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of each user's changes, no two ten minutes apart; the last change of each type of property wins."""
    kind = F.when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "error", "unlink").otherwise("change")
    e = table(spark, folder, "events").select(F.concat(F.lit("v"), F.pmod("user_id", F.lit(7)).cast("string")).alias("scope"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), kind.alias("type"), "ts", F.col("event_id").alias("seq"))
    return coalesced(e, "10 minutes")


def chunk_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Each chunk's vector by what can be told exactly of it: how many places are above and below 0, and which, as a sum."""
    v = embedded(base(spark, folder), HashProvider(64))
    total = F.aggregate(F.transform("embedding", lambda x, i: F.signum(x).cast("bigint") * (i + 1)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    n = lambda keep: F.size(F.filter("embedding", keep))
    return v.select("vault", "path", "chunk_ix", "model", F.size("embedding").alias("dimension"), n(lambda x: x > 0).alias("above"), n(lambda x: x < 0).alias("below"), total.alias("places"))


QUERIES = {f.__name__: f for f in (validation_findings, validation_rollup, missing_fields, template_match, template_errors, change_coalesce, chunk_embeddings)}

_FINDINGS = (
    LIVE
    + r""", lines AS (SELECT vault, path, unnest(string_split(content, chr(10))) AS line, unnest(range(len(string_split(content, chr(10))))) + 1 AS n FROM live),
wiki AS (SELECT vault, path, n, trim(split_part(unnest(regexp_extract_all(line, '\[\[([^\]]+)\]\]', 1)), '|', 1)) AS t FROM lines),
heads AS (SELECT vault, path, n, length(regexp_extract(line, '^(#{1,6})\s+(.+)$', 1)) AS level FROM lines WHERE regexp_matches(line, '^(#{1,6})\s+(.+)$')),
steps AS (SELECT vault, path, level AS a, lead(level) OVER w AS b, lead(n) OVER w AS n FROM heads WINDOW w AS (PARTITION BY vault, path ORDER BY n)),
"""
    + f"""plain AS (SELECT vault, path, length(p) + length(regexp_replace(p, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) AS n FROM (SELECT vault, path, {PLAIN} AS p FROM live)),
findings AS (
  SELECT vault, path, 'required-frontmatter' AS rule, 'error' AS severity, 'Missing required frontmatter field: ' || f AS message, NULL::INTEGER AS line, 'Add ' || f || ' to frontmatter' AS suggestion
    FROM (SELECT vault, path, frontmatter, unnest(['title', 'created', 'modified']) AS f FROM live) WHERE NOT coalesce(list_contains(map_keys(frontmatter), f), false)
  UNION ALL SELECT vault, path, 'valid-links', 'warning', 'Link target should end with .md: ' || t, NULL, 'Change to ' || t || '.md' FROM wiki WHERE NOT starts_with(t, 'http') AND NOT ends_with(t, '.md')
  UNION ALL SELECT vault, path, 'tag-format', 'warning', 'Tag format invalid: ' || t, NULL, 'Use lowercase, numbers, hyphens, and forward slashes only' FROM (SELECT vault, path, unnest(tags) AS t FROM live)
    WHERE t IS NOT NULL AND NOT regexp_full_match(t, '[a-z0-9][a-z0-9-/]*[a-z0-9]')
  UNION ALL SELECT vault, path, 'heading-structure', 'warning', 'Heading level jump from H' || a || ' to H' || b || ' at line ' || n, CAST(n AS INTEGER), 'Use H' || (a + 1) || ' instead of H' || b FROM steps WHERE b > a + 1
  UNION ALL SELECT vault, path, 'content-length', 'warning', 'Content too short: ' || n || ' characters (minimum: 50)', NULL, 'Add more content to provide value' FROM plain WHERE n < 50
  UNION ALL SELECT vault, path, 'content-length', 'warning', 'Content very long: ' || n || ' characters (consider splitting)', NULL, 'Consider breaking into multiple files' FROM plain WHERE n > 10000)
"""
)
_FM = "frontmatter['{0}']"
_MATCH = "CASE WHEN regexp_matches(lower(replace(path, '\\', '/')), '^daily/.*\\.md$') THEN '^daily/.*\\.md$' WHEN regexp_matches(lower(replace(path, '\\', '/')), 'projects/') THEN 'projects/' END"


def _missing(name: str, pattern: str) -> str:
    has = f"coalesce(list_contains(map_keys(frontmatter), '{name}'), false)"
    return f"SELECT vault, path, template, '{name}' AS field, CASE WHEN NOT {has} THEN 'missing' WHEN coalesce({_FM.format(name)}, 'null') = 'null' THEN 'null' END AS error FROM m WHERE template = '{pattern}'"


def _typed(name: str, pattern: str, form: str, extra: str = "") -> str:
    v = _FM.format(name)
    return f"SELECT vault, path, template, '{name}' AS field, CASE WHEN {v} <> 'null' AND NOT regexp_matches({v}, '{form}') THEN 'type' {extra} END AS error FROM m WHERE template = '{pattern}' AND {v} IS NOT NULL"


_D, _P = "^daily/.*\\.md$", "projects/"
# The rules' messages are output values, repeated in the SQL.
_EMBEDDED = """
WITH cur AS (SELECT note_id, max(rev) AS rev FROM notes GROUP BY note_id),
live AS (SELECT n.note_id, any_value(vault) AS vault, any_value(path) AS path, any_value(chunks) AS chunks FROM notes n JOIN cur c ON n.note_id = c.note_id AND n.rev = c.rev WHERE n.deleted_at IS NULL GROUP BY n.note_id),
each AS (SELECT note_id, vault, path, unnest(chunks) AS chunk, unnest(range(len(chunks))) AS ix FROM live),
words AS (SELECT note_id, ix, md5(unnest(list_filter(regexp_split_to_array(lower(chunk), '\\s+'), lambda w: w <> ''))) AS h FROM each),
slots AS (SELECT note_id, ix, CAST(('0x' || substr(h, 1, 16))::UBIGINT % 64 AS INTEGER) AS slot, sum(CASE WHEN substr(h, 1, 1) >= '8' THEN 1 ELSE -1 END) AS v FROM words GROUP BY 1, 2, 3),
sums AS (SELECT note_id, ix, count(*) FILTER (v > 0) AS above, count(*) FILTER (v < 0) AS below, sum(CAST(sign(v) AS BIGINT) * (slot + 1)) AS places FROM slots GROUP BY 1, 2)
SELECT vault, path, CAST(e.ix AS INTEGER) AS chunk_ix, 'hash-64' AS model, 64 AS dimension, CAST(coalesce(above, 0) AS INTEGER) AS above, CAST(coalesce(below, 0) AS INTEGER) AS below, CAST(coalesce(places, 0) AS BIGINT) AS places
FROM each e LEFT JOIN sums s ON s.note_id = e.note_id AND s.ix = e.ix"""
ORACLES = {
    "chunk_embeddings": _EMBEDDED,
    "validation_findings": _FINDINGS + "SELECT * FROM findings",
    "validation_rollup": _FINDINGS
    + """SELECT l.vault, l.path, count(*) FILTER (severity = 'error') = 0 AS valid, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings
FROM live l LEFT JOIN findings f ON f.vault = l.vault AND f.path = l.path GROUP BY 1, 2""",
    "missing_fields": LIVE
    + """, f AS (SELECT vault, path, frontmatter, unnest(['title', 'created', 'status']) AS field FROM live),
p AS (SELECT vault, path, field, CASE WHEN NOT coalesce(list_contains(map_keys(frontmatter), field), false) THEN 'missing' WHEN coalesce(frontmatter[field], 'null') = 'null' THEN 'null' END AS problem FROM f)
SELECT * FROM p WHERE problem IS NOT NULL""",
    "template_match": LIVE + f"SELECT vault, path, {_MATCH} AS template FROM live",
    "template_errors": LIVE
    + f", m AS (SELECT vault, path, frontmatter, {_MATCH} AS template FROM live), e AS ("
    + " UNION ALL ".join(
        [
            _missing("title", _D), _missing("date", _D), _typed("title", _D, '^"'), _typed("tags", _D, r"^\["), _typed("aliases", _D, r"^\["), _missing("title", _P), _missing("created", _P), _typed("created", _P, '^"'),
            _typed("priority", _P, r"^-?\d+(\.0+)?$", "WHEN try_cast(frontmatter['priority'] AS DOUBLE) < 1 THEN 'minimum' WHEN try_cast(frontmatter['priority'] AS DOUBLE) > 3 THEN 'maximum'"),
        ]
    )
    + ") SELECT * FROM e WHERE error IS NOT NULL",
    "change_coalesce": """WITH e AS (SELECT 'v' || (user_id % 7) AS scope, 'u' || user_id AS path, CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'unlink' ELSE 'change' END AS type, ts, event_id AS seq FROM events),
n AS (SELECT *, coalesce(CAST(epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 600000000 AS INTEGER), 1) AS fresh FROM e WINDOW w AS (PARTITION BY scope ORDER BY ts, seq)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY scope ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS session FROM n)
SELECT scope, CAST(session AS BIGINT) AS session, path, arg_max(type, (ts, seq)) AS type, count(*) AS events, max(ts) AS last_ts FROM s GROUP BY 1, 2, 3""",
}
