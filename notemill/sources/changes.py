"""A stream of file changes of a note folder, as a Python data source.

Spark's file source reports new paths only; this one compares snapshots of (path, size, mtime), so edits and removals
arrive too.  Files present at the start are not changes.  The offset is the manifest itself, kept as JSON in the
checkpoint, so a restarted query goes on from the last committed snapshot.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

SCHEMA = "type string, path string, ts timestamp, seq bigint"


def snapshot(root: str, depth: int = 10, stable_s: float = 0.1) -> dict[str, list[int]]:
    """path -> [size, mtime in ns] of the files below ``root``, without dot files, node_modules, *.tmp, links and files
    written within the last ``stable_s`` seconds."""
    out: dict[str, list[int]] = {}
    now = time.time_ns()
    for folder, dirs, files in os.walk(root, followlinks=False):
        at = os.path.relpath(folder, root)
        level = 0 if at == "." else at.count(os.sep) + 1
        dirs[:] = sorted(d for d in dirs if not d.startswith(".") and d != "node_modules") if level < depth else []
        for f in sorted(files):
            full = os.path.join(folder, f)
            if f.startswith(".") or f.endswith(".tmp") or os.path.islink(full):
                continue
            try:
                s = os.stat(full)
            except OSError:
                continue
            if now - s.st_mtime_ns >= stable_s * 1e9:
                out[os.path.relpath(full, root).replace(os.sep, "/")] = [s.st_size, s.st_mtime_ns]
    return out


def differences(old: dict[str, list[int]], new: dict[str, list[int]]) -> list[tuple[str, str]]:
    """(type, path) of what was added, changed and removed, by path."""
    out = [("add" if p not in old else "change", p) for p in new if old.get(p) != new[p]]
    return sorted(out + [("unlink", p) for p in old if p not in new], key=lambda x: x[1])


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.stable = options["path"], float(options.get("stable", 0.1))

    def initialOffset(self) -> dict:
        return {"files": json.dumps(snapshot(self.root, stable_s=0)), "seq": 0, "at": time.time_ns()}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        from datetime import datetime, timezone

        old = json.loads(start["files"])
        new = snapshot(self.root, stable_s=self.stable)
        changes = differences(old, new)
        # a file that is being written keeps its old entry until it rests
        at = time.time_ns()
        ts = datetime.fromtimestamp(at / 1e9, timezone.utc)
        rows = [(kind, path, ts, start["seq"] + i) for i, (kind, path) in enumerate(changes)]
        return iter(rows), {"files": json.dumps(new), "seq": start["seq"] + len(rows), "at": at if rows else start["at"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        from datetime import datetime, timezone

        ts = datetime.fromtimestamp(end["at"] / 1e9, timezone.utc)
        return iter([(k, p, ts, start["seq"] + i) for i, (k, p) in enumerate(differences(json.loads(start["files"]), json.loads(end["files"])))])


class NoteChanges(DataSource):
    """``spark.dataSource.register(NoteChanges)``, then ``spark.readStream.format("note_changes").option("path", folder)``."""

    @classmethod
    def name(cls) -> str:
        return "note_changes"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Reader(self.options)
