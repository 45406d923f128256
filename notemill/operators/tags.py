"""The tag index: which notes hold which tags, and what follows from it.  All results are per vault."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.functions.keys import normal_tag, normal_tags


def note_tags(notes: DataFrame) -> DataFrame:
    """(vault, path, tag, seen): one row per note and normalized tag."""
    return notes.select("vault", "path", F.explode(normal_tags("tags")).alias("tag"), F.col("last_modified").alias("seen"))


def tag_stats(tags: DataFrame) -> DataFrame:
    """(vault, tag, file_count, first_seen, last_seen, depth)."""
    out = tags.groupBy("vault", "tag").agg(F.count(F.lit(1)).alias("file_count"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"))
    return out.withColumn("depth", F.size(F.split("tag", "/", -1)))


def tag_record(tags: DataFrame, tag: str) -> DataFrame:
    """(vault, tag, file_count, first_seen, last_seen, depth, together, ancestors): one tag, with how often each other tag of its
    vault stands beside it; no row where no note has it."""
    name = F.lit(tag).alias("raw")
    one = tags.join(F.broadcast(tags.sparkSession.range(1).select(normal_tag(name).alias("tag"))), "tag", "left_semi")
    beside = tags.join(one.select("vault", "path", F.col("tag").alias("own")), ["vault", "path"]).where("tag <> own")
    counts = beside.groupBy("vault", "tag").agg(F.count(F.lit(1)).alias("n")).groupBy("vault").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "n")))).alias("together"))
    none = F.create_map().cast("map<string,bigint>")
    return tag_stats(one).join(counts, "vault", "left").withColumns({"together": F.coalesce("together", none), "ancestors": ancestors("tag")})


def cooccurrences(tags: DataFrame) -> DataFrame:
    """(vault, tag, other, n): in how many notes each ordered pair of different tags meets.

    Pairs are made within a note's own sorted list, so the only shuffles are by note and of the combined counts.
    """
    lists = tags.groupBy("vault", "path").agg(F.array_sort(F.collect_set("tag")).alias("l"))
    pairs = lists.select("vault", F.explode("l").alias("tag"), "l").select("vault", "tag", F.explode("l").alias("other")).where("tag <> other")
    return pairs.groupBy("vault", "tag", "other").agg(F.count(F.lit(1)).alias("n"))


def top_cooccurring(tags: DataFrame, limit: int = 10) -> DataFrame:
    """:func:`cooccurrences` with ``rank`` for the ``limit`` most frequent others of each tag, ties by name."""
    w = Window.partitionBy("vault", "tag").orderBy(F.desc("n"), "other")
    return cooccurrences(tags).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def files_by_tags(tags: DataFrame, wanted: Sequence[str], mode: str = "and") -> DataFrame:
    """(vault, path) of the notes that hold all (``and``) or any (``or``) of the tags, which are normalized first.

    No wanted tags give no notes; nor do tags that normalize to nothing.
    """
    if mode not in ("and", "or"):
        raise ValueError("mode must be 'and' or 'or'")
    names = tags.sparkSession.createDataFrame([(t,) for t in wanted], "tag string").select(normal_tag("tag").alias("tag")).where("tag <> ''").distinct()
    want = [r["tag"] for r in names.collect()]  # the caller's own list
    found = tags.where(F.col("tag").isin(want)) if want else tags.where(F.lit(False))
    per = found.groupBy("vault", "path").agg(F.count_distinct("tag").alias("_n"))
    return (per.where(F.col("_n") == len(want)) if mode == "and" else per).select("vault", "path")


def tags_of_file(tags: DataFrame, path: str) -> DataFrame:
    """(vault, tag) of one note, sorted by tag."""
    return tags.where(F.col("path") == path).select("vault", "tag").orderBy("vault", "tag")


def ancestors(tag: Column | str) -> Column:
    """All proper prefixes of a tag's hierarchy, shortest first."""
    t = F.col(tag) if isinstance(tag, str) else tag
    parts = F.split(t, "/", -1)
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def child_tags(tags: DataFrame) -> DataFrame:
    """(vault, parent, tag): each existing tag below its direct parent, whether or not that exists itself."""
    names = tags.select("vault", "tag").distinct().where(F.instr("tag", "/") > 0)
    return names.select("vault", F.regexp_replace("tag", r"/[^/]*\z", "").alias("parent"), "tag")


def suggested_tags(tags: DataFrame, existing: Sequence[str], limit: int = 10) -> DataFrame:
    """(vault, tag, score, reason, rank): ten most frequent companions of each existing tag that are not present yet
    (score: the count), existing ancestors (5) and direct children (3).

    As in the model nothing is merged: a tag may come twice, and hierarchy suggestions may repeat existing tags.
    """
    spark = tags.sparkSession
    have = spark.createDataFrame([(i, t) for i, t in enumerate(existing)], "i int, raw string").select("i", normal_tag("raw").alias("tag")).where("tag <> ''").dropDuplicates(["tag"])
    have = F.broadcast(have)
    names = tags.select("vault", "tag").distinct()
    # only the existing tags' notes matter
    mates = tags.join(have.select("tag"), "tag", "left_semi").select("vault", "path", F.col("tag").alias("have"))
    co = mates.join(tags.select("vault", "path", "tag"), ["vault", "path"]).where("have <> tag").groupBy("vault", "have", "tag").agg(F.count(F.lit(1)).alias("score"))
    w = Window.partitionBy("vault", "have").orderBy(F.desc("score"), "tag")
    co = co.withColumn("r", F.row_number().over(w)).where("r <= 10").join(have.select("tag"), "tag", "left_anti")
    up = have.select(F.explode(ancestors("tag")).alias("tag"))
    up = names.join(F.broadcast(up), "tag").select("vault", "tag", F.lit(5).cast("bigint").alias("score"))
    down = child_tags(tags).join(have.select(F.col("tag").alias("parent")), "parent").select("vault", "tag", F.lit(3).cast("bigint").alias("score"))
    hierarchy = up.unionByName(down).withColumn("reason", F.lit("hierarchy"))
    every = co.select("vault", "tag", "score", F.lit("co_occurrence").alias("reason")).unionByName(hierarchy.select("vault", "tag", "score", "reason"))
    w = Window.partitionBy("vault").orderBy(F.desc("score"), "reason", "tag")
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def bulk_tags(notes: DataFrame, operation: str, tags: Sequence[str], target_tags: Sequence[str] | None = None) -> DataFrame:
    """(vault, path, old_tags, new_tags) of the notes that a bulk operation changes; raw tags, letter case counts.

    ``add`` appends what is missing; ``remove`` drops target_tags (or tags), all repeats; ``replace`` drops target_tags,
    appends tags, and always counts as a change.
    """
    none = F.array().cast("array<string>")
    old = F.coalesce(F.col("tags"), none)
    lit = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    without = lambda xs: F.filter(old, lambda t: ~F.coalesce(F.array_contains(lit(xs), t), F.lit(False))) if xs else old
    if operation == "add":
        new = F.concat(old, F.filter(F.array_distinct(lit(tags)), lambda t: ~F.coalesce(F.array_contains(old, t), F.lit(False))))
        changed = F.size(new) != F.size(old)
    elif operation == "remove":
        new = without(target_tags or tags)
        changed = F.size(new) != F.size(old)
    elif operation == "replace":
        new, changed = F.concat(without(target_tags or []), lit(tags)), F.lit(True)
    else:
        raise ValueError("operation must be add, remove or replace")
    return notes.where(changed).select("vault", "path", old.alias("old_tags"), new.alias("new_tags"))
