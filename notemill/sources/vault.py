"""Notes read from folders of markdown files, and written back."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from notemill.functions import text as T
from notemill.operators.notes import changed_paths
from notemill.session import cut

#: Files in folders of these names, and in folders or under names that start with a dot, are not notes.
SKIPPED = r"(\A|/)(\.[^/]*|node_modules)(/|\z)"
#: Paths of markdown files.
MARKDOWN = r"(?i)\.md\z"
_FENCE = r"(?s)\A---[^\S\n]*\n(.*?)(?:\n)?---[^\S\n]*(?:\n|\z)"


def safe_path(base: str, relative: str) -> str:
    """The absolute path of a file below ``base``; paths that leave it, also to a sibling of a longer name, are refused."""
    full = os.path.realpath(os.path.join(base, relative))
    root = os.path.realpath(base)
    if ".." in relative.replace("\\", "/").split("/") or os.path.commonpath([root, full]) != root:
        raise ValueError(f"path outside the vault: {relative}")
    return full


def _files(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)


def listing(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """(path, size, mtime) of all files below ``root``, relative, without skipped folders; file contents are not read."""
    return _relative(_tree(spark, root), root, pattern)


def file_info(spark: SparkSession, root: str, paths: Sequence[str]) -> DataFrame:
    """(path, present, size, mtime) of the paths asked for; what is not there has size 0 and the first moment of 1970."""
    asked = spark.createDataFrame([(p,) for p in paths], "path string")
    found = listing(spark, root).withColumn("present", F.lit(True))
    return asked.join(found, "path", "left").select("path", F.coalesce("present", F.lit(False)).alias("present"), F.coalesce("size", F.lit(0).cast("bigint")).alias("size"), F.coalesce("mtime", F.timestamp_seconds(F.lit(0))).alias("mtime"))


def _tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, mtime) of all files below ``root``, with their full paths.

    Folders are listed by tasks, one level after the other; the driver learns only whether a further level exists.
    """
    start = root if "://" in root or root.startswith("file:") else os.path.abspath(root)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for f in frames:
            for folder in f["path"]:
                files, at = fs.FileSystem.from_uri(folder)
                base = folder[: -len(at)] if folder.endswith(at) else ""
                rows = [(base + x.path, x.size or 0, x.mtime, x.type == fs.FileType.Directory) for x in files.get_file_info(fs.FileSelector(at, allow_not_found=True))]
                yield pd.DataFrame(rows, columns=["path", "size", "mtime", "folder"]).astype({"size": "int64", "folder": bool})

    schema = "path string, size bigint, mtime timestamp, folder boolean"
    level, out = spark.createDataFrame([(start,)], "path string"), None
    while True:
        found = cut(level.repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, schema), "vault-level")
        out = found if out is None else out.unionByName(found)
        # folders that hold no notes are not entered
        level = found.where(F.col("folder") & ~F.substring("path", F.lit(len(start) + 1), F.length("path")).rlike(SKIPPED)).select("path")
        if level.isEmpty():
            # whole milliseconds, as Spark's own reader gives them
            return out.where("NOT folder").select("path", "size", F.date_trunc("millisecond", "mtime").alias("mtime"))


def _empty_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, mtime) of the files of no bytes, which Spark's reader passes over."""
    return _tree(spark, root).where("size = 0")


def _relative(files: DataFrame, root: str, pattern: str | None) -> DataFrame:
    prefix = re.sub(r"\Afile:/*", "/", root).rstrip("/") if "://" not in root or root.startswith("file:") else root.rstrip("/")
    out = files.withColumn("path", F.regexp_replace("path", r"\Afile:/+", "/"))
    out = out.withColumn("path", F.substring("path", F.lit(len(prefix) + 2), F.length("path"))).where(~F.col("path").rlike(SKIPPED))
    return out if pattern is None else out.where(F.col("path").rlike(pattern))


def markdown_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, mtime, text) of the markdown files below ``root``."""
    files = _files(spark, root)
    rows = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.col("content").cast("string").alias("text"))
    rows = rows.unionByName(_empty_files(spark, root).withColumn("text", F.lit("")))
    return _relative(rows, root, None).where(T.is_markdown("path"))


@F.pandas_udf(MapType(StringType(), StringType()))
def yaml_map(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Each entry of a YAML mapping as JSON text; null for broken YAML, empty for other values."""
    import yaml

    def read(x: str | None) -> dict[str, str] | None:
        if not isinstance(x, str) or not x.strip():
            return {}
        try:
            data = yaml.safe_load(x)
        except yaml.YAMLError:
            return None
        if not isinstance(data, dict):
            return {}
        show = lambda v: v.isoformat() if hasattr(v, "isoformat") else str(v)
        return {str(k): json.dumps(v, ensure_ascii=False, default=show) for k, v in data.items()}

    for t in texts:
        yield t.map(read)


def body_of(text: Column | str) -> Column:
    """A file's text after its frontmatter."""
    return F.regexp_replace(F.col(text) if isinstance(text, str) else text, _FENCE, "")


def parsed(files: DataFrame, vault: str, chunk_size: int = 1000) -> DataFrame:
    """Notes in the form that the operators take, with ``_error`` where the frontmatter is broken (such rows keep their text).

    Columns: vault, path, ord, last_modified, size, content_hash, frontmatter, content, chunks, tags, links, title, _error.
    """
    head = F.when(F.col("text").rlike(_FENCE), F.regexp_extract("text", _FENCE, 1))
    rows = files.withColumn("frontmatter", yaml_map(F.coalesce(head, F.lit("")))).withColumn("content", body_of("text"))
    broken = F.col("frontmatter").isNull()
    rows = rows.withColumn("_error", F.when(broken, "frontmatter is not valid YAML")).withColumn("frontmatter", F.coalesce("frontmatter", F.create_map().cast("map<string,string>")))
    fm_tags = F.from_json(F.try_element_at("frontmatter", F.lit("tags")), "array<string>")
    plain = T.plain_text("content")
    title = F.get_json_object(F.concat(F.lit('{"v":'), F.try_element_at("frontmatter", F.lit("title")), F.lit("}")), "$.v")
    return rows.select(
        F.lit(vault).alias("vault"), "path", F.xxhash64("path").alias("ord"), F.col("mtime").alias("last_modified"), "size", T.content_hash("content").alias("content_hash"), "frontmatter", "content",
        T.chunked(plain, chunk_size).alias("chunks"), T.tags_of("content", fm_tags).alias("tags"), T.links_of("content").alias("links"), title.alias("title"), "_error",
    )


def read_vault(spark: SparkSession, root: str, vault: str, chunk_size: int = 1000) -> DataFrame:
    """The index of a vault folder."""
    return parsed(markdown_files(spark, root), vault, chunk_size)


def update_index(index: DataFrame, spark: SparkSession, root: str, vault: str, chunk_size: int = 1000) -> DataFrame:
    """The index after the folder changed: only new and newer files are parsed again, vanished ones go."""
    change = changed_paths(index.select("path", F.col("last_modified").alias("mtime")), listing(spark, root, MARKDOWN))
    fresh = markdown_files(spark, root).join(change.where("change <> 'unlink'").select("path"), "path", "left_semi")
    return index.join(change.select("path"), "path", "left_anti").unionByName(parsed(fresh, vault, chunk_size))


def markdown_text(frontmatter: dict, content: str) -> str:
    """A file's text; without frontmatter just the content."""
    import yaml

    return f"---\n{yaml.safe_dump(frontmatter, allow_unicode=True, sort_keys=False)}---\n{content}" if frontmatter else content


def split_text(text: str) -> tuple[dict, str]:
    """(frontmatter, content) of a file's text."""
    import yaml

    m = re.match(r"---[^\S\n]*\n(.*?)\n?---[^\S\n]*(?:\n|\Z)", text, re.S)
    if not m:
        return {}, text
    data = yaml.safe_load(m.group(1))
    return (data if isinstance(data, dict) else {}), text[m.end() :]


def write_file(root: str, path: str, text: str) -> None:
    """Write one note; its folder must exist, as in the model."""
    with open(safe_path(root, path), "w", encoding="utf-8") as f:
        f.write(text)


def write_files(rows: DataFrame, root: str) -> None:
    """Write (path, text) below ``root``, a folder that all executors share, one file per row, by the tasks; a null text removes
    the file.  Folders are made as needed; a task that runs again writes the same files again."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(root)
        for f in frames:
            for path, text in zip(f["path"], f["text"], strict=True):
                at = f"{base}/{path}"
                if text is None:
                    if files.get_file_info(at).type != fs.FileType.NotFound:
                        files.delete_file(at)
                    continue
                files.create_dir(at.rsplit("/", 1)[0])
                with files.open_output_stream(at) as out:
                    out.write(text.encode("utf-8"))
            yield f[["path"]].iloc[:0]

    rows.where(~F.col("path").rlike(r"(\A|/)\.\.(/|\z)")).select("path", "text").mapInPandas(run, "path string").write.format("noop").mode("overwrite").save()


def read_file(root: str, path: str) -> str:
    with open(safe_path(root, path), encoding="utf-8") as f:
        return f.read()


def delete_file(root: str, path: str) -> None:
    os.remove(safe_path(root, path))


def tag_rewriter(root: str, stamp: str):
    """A function for ``foreachPartition`` over (path, new_tags): files get the tags and a new modification time."""

    def run(rows) -> None:
        for r in rows:
            front, body = split_text(read_file(root, r["path"]))
            write_file(root, r["path"], markdown_text(front | {"tags": list(r["new_tags"]), "modified": stamp}, body))

    return run
