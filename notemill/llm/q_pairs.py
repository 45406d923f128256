"""Queries on similar sets (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.functions.keys import normal_tags, target_key
from notemill.llm.setjoin import expanded, similar_pairs
from notemill.operators.notes import live_notes
from notemill.sources.tables import table

THRESHOLD, MIN_SIZE = 0.6, 4


def _sets(spark: SparkSession, folder: str) -> DataFrame:
    """(rec, items): one record per live note and set field; rec is 2 * note_id for tags, 2 * note_id + 1 for links."""
    notes = table(spark, folder, "notes")
    links = F.transform(
        F.coalesce(F.col("links.target"), F.array().cast("array<string>")),
        lambda t: F.concat(F.lit("l\x00"), F.col("vault"), F.lit("\x00"), target_key(F.col("path"), t)),
    )
    tags = F.transform(normal_tags("tags"), lambda t: F.concat(F.lit("t\x00"), t))
    rows = live_notes(notes, {"t": tags, "l": links})
    both = F.explode(F.array(F.struct((F.col("note_id") * 2).alias("rec"), F.col("t").alias("items")), F.struct((F.col("note_id") * 2 + 1).alias("rec"), F.col("l").alias("items"))))
    return rows.select(both.alias("s")).select("s.rec", "s.items")


def _field(rec: str) -> F.Column:
    return F.when(F.col(rec) % 2 == 0, "tags").otherwise("links")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of live notes with largely the same tags or links."""
    members, pairs = similar_pairs(_sets(spark, folder), "rec", "items", THRESHOLD, MIN_SIZE)
    out = expanded(members, pairs)
    note = lambda c: F.floor(F.col(c) / 2).cast("bigint")
    return out.select(_field("a").alias("set_field"), note("a").alias("note_a"), note("b").alias("note_b"))


def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record: its class of equal sets, the class's size and its number of similar classes."""
    members, pairs = similar_pairs(_sets(spark, folder), "rec", "items", THRESHOLD, MIN_SIZE)
    ends = pairs.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    sizes = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("first"))
    per = sizes.join(ends, "class_id", "left").withColumn("links", F.coalesce("links", F.lit(0).cast("bigint")))
    out = members.join(per, "class_id")
    note = lambda c: F.floor(F.col(c) / 2).cast("bigint")
    return out.select(_field("id").alias("set_field"), note("id").alias("note_id"), note("first").alias("class_note"), "members", "links")


_PATH_KEY = "regexp_replace(lower(trim(regexp_replace(replace({0}, '\\', '/'), '/+', '/', 'g'), ' /')), '\\.md$', '')"
_FOLD = """array_to_string(list_reduce(list_transform(string_split({0}, '/'), lambda p: [p]),
  lambda acc, p: CASE WHEN p[1] IN ('', '.') THEN acc WHEN p[1] = '..' THEN acc[1:greatest(len(acc) - 1, 0)] ELSE list_concat(acc, p) END,
  []::VARCHAR[]), '/')"""
_LIVE = """cur AS (SELECT note_id, max(rev) AS rev FROM notes GROUP BY note_id),
live AS (SELECT n.note_id, any_value(vault) AS vault, any_value(path) AS path, any_value(tags) AS tags, any_value(links) AS links FROM notes n JOIN cur c ON n.note_id = c.note_id AND n.rev = c.rev
  WHERE n.deleted_at IS NULL GROUP BY n.note_id)"""
_SETS = f"""
WITH {_LIVE},
raw AS (SELECT note_id, vault, {_PATH_KEY.format("path")} AS skey, trim(replace(url_decode(split_part(u.target, '#', 1)), '\\', '/')) AS raw
  FROM (SELECT note_id, vault, path, unnest(links) AS u FROM live) WHERE u.target IS NOT NULL),
items AS (
  SELECT DISTINCT 'tags' AS set_field, note_id, tag AS item FROM (SELECT note_id, regexp_replace(regexp_replace(trim(lower(t)), '^#', ''), '\\s+', '-', 'g') AS tag FROM (SELECT note_id, unnest(tags) AS t FROM live)) WHERE tag <> ''
  UNION ALL
  SELECT DISTINCT 'links', note_id, vault || '|' || CASE WHEN raw = '' THEN skey ELSE {_PATH_KEY.format(_FOLD.format("CASE WHEN starts_with(raw, '/') THEN raw ELSE regexp_replace(skey, '[^/]*$', '') || raw END"))} END FROM raw),
sizes AS (SELECT set_field, note_id, count(*) AS n FROM items GROUP BY 1, 2 HAVING count(*) >= 4),
"""
_PAIRS = """shared AS (SELECT a.set_field, a.note_id AS note_a, b.note_id AS note_b, count(*) AS s FROM items a JOIN items b ON a.set_field = b.set_field AND a.item = b.item AND a.note_id < b.note_id GROUP BY 1, 2, 3),
found AS (SELECT s.set_field, note_a, note_b FROM shared s JOIN sizes x ON x.set_field = s.set_field AND x.note_id = note_a JOIN sizes y ON y.set_field = s.set_field AND y.note_id = note_b
  WHERE s * 10 >= 6 * (x.n + y.n - s))
"""
QUERIES = {"p1_found": p1_found, "p1_classes": p1_classes}
_CLASSES = """keyed AS (SELECT set_field, note_id, list_sort(list(item)) AS s FROM items GROUP BY 1, 2 HAVING count(*) >= 4),
cls AS (SELECT set_field, s, min(note_id) AS class_note, count(*) AS members FROM keyed GROUP BY 1, 2),
each AS (SELECT set_field, class_note, len(s) AS n, unnest(s) AS item FROM cls),
met AS (SELECT a.set_field, a.class_note AS x, b.class_note AS y, count(*) AS c, any_value(a.n) AS p, any_value(b.n) AS q FROM each a JOIN each b ON a.set_field = b.set_field AND a.item = b.item AND a.class_note < b.class_note GROUP BY 1, 2, 3),
ends AS (SELECT set_field, x AS class_note FROM met WHERE c * 10 >= 6 * (p + q - c) UNION ALL SELECT set_field, y FROM met WHERE c * 10 >= 6 * (p + q - c)),
linked AS (SELECT set_field, class_note, count(*) AS links FROM ends GROUP BY 1, 2)
SELECT k.set_field, k.note_id, c.class_note, members, coalesce(links, 0) AS links FROM keyed k JOIN cls c ON k.set_field = c.set_field AND k.s = c.s
LEFT JOIN linked l ON l.set_field = c.set_field AND l.class_note = c.class_note"""
ORACLES = {"p1_classes": _SETS + _CLASSES, "p1_found": _SETS + _PAIRS + "SELECT set_field, note_a, note_b FROM found"}
