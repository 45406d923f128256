"""Session defaults and durable lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CUTS: list[tuple[SparkSession, str]] = []


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster the submitter's own session is used instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("notemill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    The setting is read from the session.  Only where it is unset and the master is local (tests, a laptop) a folder is made,
    removed at the end of the process, and the setting is filled with it, so that every later call agrees.  On a cluster without
    the setting this is an error: executors would write to disks of their own.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):  # all processes of local-cluster share one machine as well
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="notemill-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        where = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


@contextmanager
def static_plans(spark: SparkSession) -> Iterator[None]:
    """Within it plans are not replanned at run time: for loops over tables that keep one partitioning, where replanning
    would merge partitions and so add a shuffle to every round.  Holds for what is run within, as :func:`cut` does."""
    name = "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    Unlike ``localCheckpoint`` the result survives the loss of any executor, and unlike ``persist`` it forgets the
    lineage.  The table is removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/notemill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _CUTS.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def removed_at_end(spark: SparkSession, path: str) -> None:
    """Have a folder of the shared one removed together with the tables of :func:`cut`."""
    _CUTS.append((spark, path))


def drop_cuts() -> None:
    """Remove every table that :func:`cut` has written in this process."""
    while _CUTS:
        spark, path = _CUTS.pop()
        try:
            jvm = spark.sparkContext._jvm
            hadoop = jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session is gone: nothing to do
            pass


atexit.register(drop_cuts)
