"""Numbers in order without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notemill.session import cut


def numbered(rows: DataFrame, scope: str, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with ``name``: the position of each row in its scope, from 0, by ``order`` (unique within a scope).

    Rows are range-partitioned by scope and order and written once; a scope that holds a third of all rows is spread over
    many partitions.  One count per partition and scope in it is summed up and joined back.
    """
    parts = cut(rows.repartitionByRange(scope, *order).withColumn("_part", F.spark_partition_id()), "numbered")
    counts = parts.groupBy(scope, "_part").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(scope).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(scope, "_part", F.coalesce(before, F.lit(0)).alias("_start"))
    local = F.row_number().over(Window.partitionBy(scope, "_part").orderBy(*order)) - 1
    out = parts.withColumn("_local", local).join(starts, [scope, "_part"])
    return out.withColumn(name, F.col("_start") + F.col("_local")).drop("_part", "_local", "_start")
