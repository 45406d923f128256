"""Queries that write a vault folder from the notes table and read it back: sources, sinks and incremental upkeep."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.plans.note_queries import LIVE, base
from notemill.session import cut, removed_at_end, shared_dir
from notemill.sources import vault as V


def _written(spark: SparkSession, folder: str) -> tuple[DataFrame, str]:
    """The live notes as files, one folder per vault, in a folder of the shared one; (path, text) of them and where they are."""
    root = f"{shared_dir(spark)}/notemill/cut-vault-{uuid.uuid4().hex}"
    name = F.concat(F.col("vault"), F.lit("/"), F.col("ord").cast("string"), F.lit(".md"))
    rows = cut(base(spark, folder).select("ord", name.alias("path"), F.coalesce("content", F.lit("")).alias("text")), "vault-texts")
    V.write_files(rows, root)
    removed_at_end(spark, root)
    return rows, root


def _shown(index: DataFrame) -> DataFrame:
    return index.select("path", "size", F.md5("content").alias("digest"), F.size("tags").alias("tags"))


def vault_read(spark: SparkSession, folder: str) -> DataFrame:
    """The index of all live notes, read from files."""
    _, root = _written(spark, folder)
    return _shown(V.read_vault(spark, root, "all"))


def vault_update(spark: SparkSession, folder: str) -> DataFrame:
    """The index after some files grew and some went, brought up to date from the index before."""
    rows, root = _written(spark, folder)
    index = cut(V.read_vault(spark, root, "all"), "vault-index")
    changed = F.when(F.col("ord") % 11 == 0, F.lit(None).cast("string")).otherwise(F.concat("text", F.lit("\n#fresh\n")))
    V.write_files(rows.where("ord % 7 = 0 OR ord % 11 = 0").select("path", changed.alias("text")), root)
    return _shown(V.update_index(index, spark, root, "all"))


QUERIES = {"vault_read": vault_read, "vault_update": vault_update}
_SHOWN = """SELECT vault || '/' || ord || '.md' AS path, CAST(strlen(c) AS BIGINT) AS size, md5(c) AS digest, len(list_distinct(regexp_extract_all(c, '#([a-zA-Z0-9_/-]+)', 1))) AS tags FROM """
ORACLES = {
    "vault_read": LIVE + _SHOWN + "(SELECT *, coalesce(content, '') AS c FROM live)",
    "vault_update": LIVE + _SHOWN + "(SELECT *, CASE WHEN ord % 7 = 0 THEN coalesce(content, '') || chr(10) || '#fresh' || chr(10) ELSE coalesce(content, '') END AS c FROM live WHERE ord % 11 <> 0)",
}
