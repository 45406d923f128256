"""Joins that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key with more than 1/HOT_SHARE of the rows is hot, so there are fewer than HOT_SHARE hot keys in any input.
HOT_SHARE = 200


def hot_keys(df: DataFrame, keys: Sequence[str], share: int = HOT_SHARE) -> DataFrame:
    """The keys that hold more than ``1/share`` of the rows each: fewer than ``share`` rows, whatever the input.

    The counts are combined on the map side, so a hot key costs each task one row of shuffle.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    # over the same exchange, so the rows are read once
    total = counts.agg(F.sum("_n").alias("_total"))
    return counts.join(F.broadcast(total), F.col("_n") * share > F.col("_total")).select(*keys)


def join_unique(left: DataFrame, right: DataFrame, keys: Sequence[str], share: int = HOT_SHARE) -> DataFrame:
    """``left`` left-outer-joined with ``right`` (unique by ``keys``), without a hot partition.

    The hot keys are looked up first: fewer than ``share`` rows on the driver, by :func:`hot_keys`.  Without any this is a
    plain join.  Else rows of hot keys (null among them) meet the few right rows of those keys by broadcast, and only
    the others take the shuffle join.  ``left`` is read twice or three times: cut it before if it is costly.
    """
    spark = left.sparkSession
    hot = hot_keys(left.select(*keys), keys, share).collect()
    if not hot:
        return left.join(right, list(keys), "left")
    names = {k: f"_hot{i}" for i, k in enumerate(keys)}
    fields = T.StructType([T.StructField(names[k], left.schema[k].dataType) for k in keys])
    few = F.broadcast(spark.createDataFrame([tuple(r) for r in hot], fields).withColumn("_is_hot", F.lit(True)))
    same, equal = F.lit(True), F.lit(True)
    for k, n in names.items():
        same, equal = same & F.col(k).eqNullSafe(F.col(n)), equal & (F.col(k) == F.col(n))
    marked = left.join(few, same, "left").drop(*names.values())
    those = F.broadcast(right.join(few, equal, "left_semi"))
    a = marked.where("_is_hot").drop("_is_hot").join(those, list(keys), "left")
    b = marked.where("_is_hot IS NULL").drop("_is_hot").join(right, list(keys), "left")
    return a.unionByName(b)
