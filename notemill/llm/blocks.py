"""Pairs within groups of any size, without a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.operators.skew import join_unique
from notemill.session import cut

#: Groups above this size are paired block by block.
BLOCK = 2000


def in_cells(rows: DataFrame, keys: Sequence[str], item: str, size: int | None = None) -> DataFrame:
    """``rows`` with the cells (i, j), i <= j, and the block ``own`` of each: the pairs between blocks i and j of a group meet there.

    A group up to ``size`` rows is one cell, (0, 0).  ``rows`` is read more than once: cut it before if it is costly.
    """
    size = size or BLOCK
    long = cut(rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("blocks")).where("blocks > 1"), "long-groups")
    if long.isEmpty():
        return rows.withColumns({c: F.lit(0) for c in ("own", "i", "j")})
    rows = join_unique(rows, long, list(keys)).withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64(item, F.lit(7)), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("blocks", "other")


def met(a: str, b: str):
    """Whether two rows of one cell are to be paired there."""
    return (F.col(f"{a}.i") == F.col(f"{a}.j")) | (F.col(f"{a}.own") != F.col(f"{b}.own"))


def pairs_within(rows: DataFrame, key: str, item: str) -> DataFrame:
    """(a, b), a < b: all pairs of items of one key; ``rows`` (key, item) is unique."""
    cells = in_cells(rows.select(key, item), [key], item)
    x, y = cells.alias("x"), cells.alias("y")
    on = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in (key, "i", "j")]
    return x.join(y, [*on, F.col(f"x.{item}") < F.col(f"y.{item}"), met("x", "y")]).select(F.col(f"x.{item}").alias("a"), F.col(f"y.{item}").alias("b"))
