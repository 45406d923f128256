"""Items that appear together: pair counts by external sort of packed 64-bit pair codes.

1. Items get dense 31-bit numbers in code-point order; a pair (a, b), a < b, is the code ``a << 32 | b``.
2. Each task makes the codes of its records in numpy, sorts them in bounded runs and run-length counts each run: a
   sorted spill run of (code, count).  So a pair that a third of all records hold is one row per run.
3. The runs are range-partitioned by code and sorted within partitions (Spark's external sorter merges the spilled
   runs); a streaming pass adds up equal neighbours, carrying the last code from batch to batch.
4. Counts of single items are joined back; lift and the odds ratio (with 0.5 added to each cell) are computed.

The a-priori bound prunes exactly: a pair cannot occur more often than its rarer item, so items below ``min_count``
never enter a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notemill.operators.skew import join_unique
from notemill.session import cut

#: Codes per sorted run in a task (8 bytes each).
RUN = 2_000_000
#: Dictionaries up to this many items are broadcast; larger ones are joined by shuffle.
BROADCAST_ITEMS = 200_000


def dictionary(items: DataFrame, item: str = "item") -> DataFrame:
    """(item, num, n) with num dense from 0 in code-point order, for a table of (item, n) unique by item.

    The table is range-partitioned and written once; one row count per partition is summed up and broadcast.
    """
    sorted_ = cut(items.repartitionByRange(item).sortWithinPartitions(item).withColumn("_part", F.spark_partition_id()), "cooccur-items")
    sums = sorted_.groupBy("_part").agg(F.count(F.lit(1)).alias("c"))
    total = sums.agg(F.sum("c")).first()[0] or 0
    if total >= 2**31:
        raise ValueError("more than 2^31 items")
    # one row for each partition
    before = F.coalesce(F.sum("c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(item)) - 1
    return sorted_.join(F.broadcast(sums.select("_part", before.alias("_start"))), "_part").withColumn("num", (F.col("_start") + local).cast("bigint")).drop("_part", "_start")


def _codes(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> Iterator[np.ndarray]:
    """Codes of all pairs within records; ``flat`` ascends within each record.  Records of one length go together."""
    for n in np.unique(lens):
        if n < 2:
            continue
        rows = starts[lens == n]
        step = max(1, RUN // max(1, n * (n - 1) // 2))
        if n <= 2000:
            i, j = np.triu_indices(n, 1)
            for k in range(0, len(rows), step):
                m = flat[rows[k : k + step, None] + np.arange(n)]
                yield (m[:, i] << 32 | m[:, j]).ravel()
        else:  # one huge record: row by row of its triangle
            for s in rows:
                m = flat[s : s + n]
                for a in range(n - 1):
                    yield m[a] << 32 | m[a + 1 :]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def run() -> pa.RecordBatch:
        code, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype(np.int64))], ["code", "n"])

    for b in batches:
        nums = b.column(0)
        flat = nums.values.to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = nums.offsets.to_numpy()
        for codes in _codes(flat, offsets[:-1].astype(np.int64), np.diff(offsets)):
            held.append(codes)
            size += len(codes)
            if size >= RUN:
                yield run()
                held, size = [], 0
    if held:
        yield run()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up equal neighbours of a sorted stream of (code, n)."""
    last, count = None, 0
    for b in batches:
        code, n = b.column(0).to_numpy(), b.column(1).to_numpy()
        if not len(code):
            continue
        if last is not None:
            code, n = np.concatenate([[last], code]), np.concatenate([[count], n])
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        sums = np.add.reduceat(n, first)
        last, count = code[first[-1]], sums[-1]
        yield pa.RecordBatch.from_arrays([pa.array(code[first[:-1]]), pa.array(sums[:-1].astype(np.int64))], ["code", "n"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.array([last], np.int64)), pa.array(np.array([count], np.int64))], ["code", "n"])


def cooccurrence(records: DataFrame, id_col: str, items_col: str, min_count: int = 1, min_share: int | None = None) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, total, lift, odds_ratio) for pairs in at least ``min_count`` records.

    ``records`` is unique by ``id_col``; ``items_col`` is an array of strings.  With ``min_share`` a pair must also be
    in at least 1/min_share of all records.  item_a < item_b by code point.  Null items and repeated items of a
    record count not at all and once; records with a null or empty array count in ``total`` only.
    """
    rows = records.select(F.col(id_col).alias("_id"), F.array_distinct(F.filter(F.coalesce(F.col(items_col), F.array().cast("array<string>")), lambda x: x.isNotNull())).alias("_items"))
    rows = cut(rows, "cooccur-records")
    total = rows.count()
    least = max(1, min_count, -(-total // min_share) if min_share else 1)
    each = rows.select("_id", F.explode("_items").alias("item"))
    counts = each.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    items = cut(dictionary(counts), "cooccur-dictionary")
    nums = items.select("item", "num")
    # with min_share the dictionary has at most min_share * (items per record) entries, whatever the input's size
    small = items.count() <= BROADCAST_ITEMS
    # a large dictionary meets an item that very many records hold by broadcast, the others by shuffle
    keyed = each.join(F.broadcast(nums), "item") if small else join_unique(each, nums, ["item"]).where("num IS NOT NULL")
    lists = keyed.groupBy("_id").agg(F.array_sort(F.collect_list("num")).alias("nums")).where(F.size("nums") > 1).select("nums")
    # written, for the range partitioning reads them twice
    runs = cut(lists.mapInArrow(_runs, "code bigint, n bigint"), "cooccur-runs")
    pairs = runs.repartitionByRange("code").sortWithinPartitions("code").mapInArrow(_merged, "code bigint, n bigint").where(F.col("n") >= least)
    pairs = pairs.select(F.shiftright("code", 32).alias("a"), F.col("code").bitwiseAND(F.lit(2**32 - 1)).alias("b"), F.col("n").alias("n_ab"))

    def side(x: str) -> DataFrame:
        d = items.select(F.col("num").alias(x), F.col("item").alias(f"item_{x}"), F.col("n").alias(f"n_{x}"))
        return F.broadcast(d) if small else d

    if not small:
        pairs = cut(pairs, "cooccur-pairs")
    both = pairs.join(side("a"), "a").join(side("b"), "b") if small else join_unique(cut(join_unique(pairs, side("a"), ["a"]), "cooccur-pairs"), side("b"), ["b"])
    out = both.withColumn("total", F.lit(total).cast("bigint"))
    ab, a, b, t = (F.col(c).cast("double") for c in ("n_ab", "n_a", "n_b", "total"))
    lift = ab * t / (a * b)
    odds = ((ab + 0.5) * (t - a - b + ab + 0.5)) / ((a - ab + 0.5) * (b - ab + 0.5))
    return out.select("item_a", "item_b", "n_ab", "n_a", "n_b", "total", lift.alias("lift"), odds.alias("odds_ratio"))
