"""Numbered versions of tables below a folder of any file system that Spark reaches."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

#: Complete versions that stay, for readers that still have the one before.
KEPT = 2


class Versions:
    """Folders ``v0``, ``v1``, ... of which one counts once it is marked complete; the greatest is the present one.

    A write that was cut short leaves an unmarked folder, which the next write of that number replaces.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.folder = folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, version: int) -> str:
        return f"{self.folder}/v{version}"

    def complete(self) -> list[int]:
        root = self._path(self.folder)
        names = [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []
        found = sorted(int(n[1:]) for n in names if re.fullmatch(r"v\d+", n))
        return [v for v in found if self._fs.exists(self._path(f"{self.at(v)}/DONE"))]

    def latest(self) -> int:
        """The present version, -1 where there is none."""
        return max(self.complete(), default=-1)

    def mark(self, version: int) -> None:
        """Declare a version complete, and remove those that are no longer kept."""
        self._fs.create(self._path(f"{self.at(version)}/DONE"), True).close()
        for v in self.complete()[:-KEPT]:
            self._fs.delete(self._path(self.at(v)), True)
