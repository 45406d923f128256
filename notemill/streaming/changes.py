"""Coalescing of change feeds, in batch and streaming form, and upkeep of an index table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from notemill.operators.skew import join_unique
from notemill.sources.store import Versions


def coalesced(changes: DataFrame, gap: str = "1 second", watermark: str | None = None) -> DataFrame:
    """(scope, start, end, path, type, events): within a session of changes of a scope (a vault), no two further apart than
    ``gap``, the last change of each path.

    ``changes``: scope, path, type, ts, seq.  The session belongs to the scope: any change keeps it open.  A stream needs a
    watermark and comes out in append mode, one row per session with an array ``paths`` (see :func:`latest_paths`); in
    batch form a session is a number per scope, and is never collected.
    """
    if watermark is not None or changes.isStreaming:
        marked = changes.withWatermark("ts", watermark or "10 minutes")
        s = marked.groupBy(F.session_window("ts", gap).alias("w"), "scope").agg(F.collect_list(F.struct("path", F.struct("ts", "seq").alias("at"), "type")).alias("changes"))
        return s.select("scope", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "changes")
    seconds = changes.sparkSession.sql(f"SELECT INTERVAL {gap} AS g").first()["g"].total_seconds()
    width = int(seconds * 1_000_000)
    # changes of one bucket as wide as the gap are in one session, so sessions are found among buckets, of which there
    # are as many as the time span allows, however many changes a scope has
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    marked = changes.withColumn("_at", at).withColumn("_bucket", F.floor(F.col("_at") / width))
    buckets = marked.groupBy("scope", "_bucket").agg(F.min("_at").alias("_lo"), F.max("_at").alias("_hi"))
    w = Window.partitionBy("scope").orderBy("_bucket")
    new = F.coalesce((F.col("_lo") - F.lag("_hi").over(w) >= width).cast("int"), F.lit(1))
    of = buckets.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).select("scope", "_bucket", "session")
    per = join_unique(marked, of, ["scope", "_bucket"]).groupBy("scope", "session", "path").agg(F.max_by("type", F.struct("ts", "seq")).alias("type"), F.count(F.lit(1)).alias("events"), F.max("ts").alias("last_ts"))
    return per.select("scope", F.col("session").cast("bigint").alias("session"), "path", "type", "events", "last_ts")


def latest_paths(sessions: DataFrame) -> DataFrame:
    """(scope, start, end, path, type): the last change of each path in the sessions of a stream."""
    last = F.explode("changes")
    each = sessions.select("scope", "start", "end", last.alias("c")).select("scope", "start", "end", "c.*")
    return each.groupBy("scope", "start", "end", "path").agg(F.max_by("type", "at").alias("type"))


def maintained(changes: DataFrame, apply: Callable[[DataFrame, DataFrame], None], checkpoint: str, gap: str = "1 second", once: bool = True) -> StreamingQuery:
    """A query that hands each micro-batch's last changes, upserts and removals, to ``apply``.

    Delivery is at least once: ``apply`` must be idempotent by path.  ``once`` ends after what is there (availableNow).
    """

    def batch(df: DataFrame, _: int) -> None:
        last = df.groupBy("path").agg(F.max_by("type", F.struct("ts", "seq")).alias("type"))
        apply(last.where("type <> 'unlink'").select("path"), last.where("type = 'unlink'").select("path"))

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=gap)).start()


def refresh_index(spark: SparkSession, table_path: str, root: str, vault: str, chunk_size: int = 1000) -> Callable[[DataFrame, DataFrame], None]:
    """An ``apply`` for :func:`maintained` that keeps an index as versions of a table (see :class:`Versions`), so readers never see
    half of one; :func:`indexed` reads the present version."""
    from notemill.sources.vault import markdown_files, parsed

    versions = Versions(spark, table_path)

    def apply(upserts: DataFrame, removals: DataFrame) -> None:
        touched = upserts.unionByName(removals)
        now = versions.latest()
        if now >= 0 and touched.isEmpty():
            return
        files = markdown_files(spark, root)
        # without a version the whole folder is read
        fresh = parsed(files if now < 0 else files.join(upserts, "path", "left_semi"), vault, chunk_size)
        rows = fresh if now < 0 else indexed(spark, table_path).join(touched, "path", "left_anti").unionByName(fresh)
        rows.write.mode("overwrite").parquet(f"{versions.at(now + 1)}/notes")
        versions.mark(now + 1)

    return apply


def indexed(spark: SparkSession, table_path: str) -> DataFrame | None:
    """The present version of an index that :func:`refresh_index` keeps, None before the first."""
    versions = Versions(spark, table_path)
    now = versions.latest()
    return None if now < 0 else spark.read.parquet(f"{versions.at(now)}/notes")


class Monitor:
    """A running upkeep query that can be flushed, stopped and asked how far it is."""

    def __init__(self, changes: DataFrame, apply: Callable[[DataFrame, DataFrame], None], checkpoint: str, gap: str = "1 second"):
        self._start = lambda: maintained(changes, apply, checkpoint, gap, once=False)
        self.query: StreamingQuery | None = None

    def start(self) -> None:
        """Begin, or go on from the checkpoint; a monitor that runs stays as it is."""
        if self.query is None or not self.query.isActive:
            self.query = self._start()

    def flush(self) -> None:
        """Hand over all changes that are there, without waiting for the next trigger."""
        if self.query is not None and self.query.isActive:
            self.query.processAllAvailable()

    def stop(self) -> None:
        """Flush what is pending, then end."""
        self.flush()
        if self.query is not None:
            self.query.stop()

    def stats(self) -> dict[str, int | bool]:
        """Whether it runs, its batches, and the changes in all of those that are still remembered."""
        done = list(self.query.recentProgress) if self.query is not None else []
        return {"running": self.query is not None and self.query.isActive, "batches": max((p["batchId"] + 1 for p in done), default=0), "changes": sum(p["numInputRows"] for p in done)}
