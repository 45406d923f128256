"""The orphan operator on streams: each micro-batch advances the state, which lives in versioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from notemill.operators.orphans import OrphanState, advance, snapshot
from notemill.sources.store import Versions


class OrphanTables:
    """The state's tables below a folder that all executors share, one sub-folder per version (see :class:`Versions`)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.versions = spark, Versions(spark, folder)

    def version(self) -> int:
        return self.versions.latest()

    def load(self) -> OrphanState:
        v = self.version()
        if v < 0:
            return OrphanState.empty(self.spark)
        at = self.versions.at(v)
        return OrphanState(self.spark.read.parquet(f"{at}/parents"), self.spark.read.parquet(f"{at}/refs"))

    def save(self, state: OrphanState, version: int) -> None:
        at = self.versions.at(version)
        state.parents.write.mode("overwrite").parquet(f"{at}/parents")
        state.refs.write.mode("overwrite").parquet(f"{at}/refs")
        self.versions.mark(version)


def follow(changes: DataFrame, tables: OrphanTables, checkpoint: str) -> StreamingQuery:
    """Follow a stream of (kind 'ref' or 'parent', and the columns of both) until it is used up.

    A batch delivered again writes the same version again, so the state is exact.
    """

    def batch(df: DataFrame, number: int) -> None:
        if number <= tables.version():
            return
        df.persist()
        try:
            state = advance(tables.load(), df.where("kind = 'ref'"), df.where("kind = 'parent'"), first=tables.version() < 0)
            tables.save(state, number)
        finally:
            df.unpersist()

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshots(tables: OrphanTables) -> DataFrame:
    """The counts of the present state, stamped with its version."""
    return snapshot(tables.load()).withColumn("version", F.lit(tables.version()))
