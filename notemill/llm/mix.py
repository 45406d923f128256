"""Mixing sources to target weights: a time-varying curriculum.

1. Tokens of every document are counted with a public tokenizer.
2. From the totals per source the demand of each source is planned: its share of the corpus total, at most
   ``max_repeats`` times what it has; what a capped source cannot give is spread over the others by share.
3. Each source's copies are laid end to end, epoch after epoch, every epoch in its own pseudo-random order; a running
   total gives each copy the stretch of the source's token demand that it covers.  Copies whose middle lies within the
   demand are drawn.
4. Each source has a weight schedule over training time t in [0, 1], piecewise linear.  Its integral is the
   cumulative demand; inverting it at the middle of a copy's stretch gives the copy's time.
5. Copies are range-sorted by time; a second running total gives the token at which each starts.

Running totals are made per range partition, with one sum per partition broadcast, so a source that holds a third
of all rows is spread like any other.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.session import cut


def token_counts(docs: DataFrame, id_col: str, text_col: str, keep: Sequence[str], vocabulary: str, pattern: str) -> DataFrame:
    """(id, *keep, tokens): tokens of each text by the byte-pair ranks in the file ``vocabulary``.

    The file has a base64 token and its rank on each line; it is sent to the executors.  A null text has 0 tokens.
    """
    docs.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        from pyspark import SparkFiles

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = [len(enc.encode_ordinary(x.as_py())) if x.is_valid else 0 for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], [*b.schema.names[:-1], "tokens"])

    fields = ", ".join(f"`{c}` {kinds[c]}" for c in [id_col, *keep])
    return docs.select(id_col, *keep, text_col).mapInArrow(run, f"{fields}, tokens bigint")


@dataclass
class SourcePlan:
    """What is to be drawn from a source."""

    share: float
    max_repeats: int
    available: int
    demand: float


def plan(total: int, available: Mapping[str, int], targets: Mapping[str, tuple[float, int]]) -> dict[str, SourcePlan]:
    """Demands that sum to ``total`` where the caps allow it, in proportion to the shares of the sources not capped."""
    weight = sum(max(0.0, s) for s, _ in targets.values())
    out = {k: SourcePlan(s / weight if weight else 0.0, max(0, r), available.get(k, 0), 0.0) for k, (s, r) in targets.items()}
    free = {k for k, p in out.items() if p.share > 0 and p.available * p.max_repeats > 0}
    left = float(total)
    while free:
        unit = left / sum(out[k].share for k in free)
        full = {k for k in free if out[k].share * unit >= out[k].available * out[k].max_repeats}
        for k in full or free:
            out[k].demand = min(out[k].share * unit, float(out[k].available * out[k].max_repeats))
        left -= sum(out[k].demand for k in full)
        free = free - full if full else set()
    return out


def tilted_schedules(plans: Mapping[str, SourcePlan], tilt: float = 0.5) -> dict[str, list[tuple[float, float]]]:
    """Linear schedules from the sources' natural weights towards more than their shares, which they have on average.

    The tilt is lessened where it would make a weight negative.
    """
    have = sum(p.available for p in plans.values()) or 1
    wanted = sum(p.demand for p in plans.values()) or 1.0
    mean = {k: p.demand / wanted for k, p in plans.items()}
    lean = {k: mean[k] - plans[k].available / have for k in plans}
    for k in plans:
        if lean[k]:
            tilt = min(tilt, mean[k] / abs(lean[k]))
    return {k: [(0.0, mean[k] - tilt * lean[k]), (1.0, mean[k] + tilt * lean[k])] for k in plans}


def inverse_time(part: Column, schedule: Sequence[tuple[float, float]]) -> Column:
    """The time at which the integral of a piecewise linear schedule reaches ``part`` (0..1) of its whole."""
    points = sorted(schedule)
    if len(points) < 2 or points[0][0] != 0 or points[-1][0] != 1 or any(w < -1e-9 for _, w in points):
        raise ValueError("a schedule needs weights of at least 0 from time 0 to time 1")
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(points, points[1:], strict=False)]
    whole = sum(areas)
    if whole <= 0:
        return part
    need, before, out = part * whole, 0.0, None
    for ((t0, w0), (t1, w1)), area in zip(zip(points, points[1:], strict=False), areas, strict=True):
        rest = F.greatest(F.lit(0.0), F.least(F.lit(area), need - before))
        slope = (w1 - w0) / (t1 - t0)
        # w0 x + slope x^2 / 2 = rest, in the form that stays exact for small slopes
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + 2 * slope * rest))
        x = F.coalesce(F.try_divide(2 * rest, root + F.lit(w0)), F.lit(0.0))
        here = F.lit(t0) + F.least(F.lit(t1 - t0), x)
        out = here if out is None else F.when(need > before, here).otherwise(out)
        before += area
    return out


def running_total(rows: DataFrame, order: Sequence[str], value: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over all rows before, in the order of ``order`` (unique).

    Rows are range-partitioned and written once; each partition's sum (one number per partition) is broadcast.
    """
    parts = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "mix-order")
    # one row for each partition
    sums = parts.groupBy("_part").agg(F.sum(value).alias("s"))
    starts = sums.select("_part", F.coalesce(F.sum("s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = parts.join(F.broadcast(starts), "_part").withColumn(name, (F.col("_start") + F.coalesce(F.sum(value).over(w), F.lit(0))).cast("bigint"))
    return out.drop("_part", "_start")


def mixed(counts: DataFrame, targets: DataFrame, id_col: str = "doc_id", source_col: str = "source", tilt: float = 0.5, schedules: Mapping[str, Sequence[tuple[float, float]]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(draw, report) from (id, source, tokens) and targets (source, target_share, max_repeats).

    draw: (start_token, id, copy, source, tokens), one row per drawn copy, range-sorted by training time.  report: one row
    per target source.  Documents without tokens, and those of a null source or of one without a target, are not
    drawn, but their tokens count in the corpus total.  Repeated ids count once (the most tokens).  Of repeated targets
    the first by share counts.  A source's draw is off its demand by at most half a document.
    """
    spark = counts.sparkSession
    rows = counts.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.struct("tokens", F.col(source_col).alias("source"))).alias("r"))
    rows = cut(rows.select("id", "r.source", "r.tokens"), "mix-counts")
    total = rows.agg(F.sum("tokens")).first()[0] or 0
    wanted = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.*")
    # one row per target
    goal = {r["source"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in wanted.collect()}
    have = rows.join(F.broadcast(wanted.select("source")), "source").groupBy("source").agg(F.sum("tokens").alias("n")).collect()
    plans = plan(total, {r["source"]: r["n"] for r in have}, goal)
    shapes = dict(tilted_schedules(plans, tilt)) | dict(schedules or {})
    order = sorted(k for k, p in plans.items() if p.demand > 0)
    sizes = spark.createDataFrame([(k, i, plans[k].available, plans[k].demand, -int(-plans[k].demand // plans[k].available)) for i, k in enumerate(order)], "source string, s int, available bigint, demand double, epochs int")
    copies = rows.where(F.col("tokens") > 0).join(F.broadcast(sizes), "source")
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1))).withColumn("dice", F.xxhash64("id", "copy"))
    laid = running_total(copies.select("s", "copy", "dice", "id", "tokens"), ["s", "copy", "dice", "id"], "tokens", "before")
    starts = {r["s"]: r["b"] for r in laid.groupBy("s").agg(F.min("before").alias("b")).collect()}
    first = F.element_at(F.create_map(*[F.lit(x) for kv in (starts or {0: 0}).items() for x in kv]), F.col("s"))
    drawn = laid.join(F.broadcast(sizes.select("s", "source", "demand")), "s").withColumn("part", (F.col("before") - first + F.col("tokens") / 2) / F.col("demand")).where(F.col("part") < 1)
    time = F.lit(None).cast("double")
    for i, k in enumerate(order):
        time = F.when(F.col("s") == i, inverse_time(F.col("part"), shapes[k])).otherwise(time)
    timed = drawn.withColumn("time", time).select("time", "dice", "id", "copy", "source", "tokens")
    draw = running_total(timed, ["time", "dice", "id", "copy"], "tokens", "start_token").select("start_token", F.col("id").alias(id_col), "copy", "source", "tokens")
    got = draw.groupBy("source").agg(F.sum("tokens").alias("drawn_tokens"), F.count_distinct(id_col).alias("docs"), (F.max("copy") + 1).alias("most_copies"))
    base = spark.createDataFrame([(k, p.share, p.max_repeats, p.available, p.demand) for k, p in sorted(plans.items())], "source string, target_share double, max_repeats int, available_tokens bigint, planned_tokens double")
    zero = F.lit(0).cast("bigint")
    report = base.join(got, "source", "left").withColumns({"drawn_tokens": F.coalesce("drawn_tokens", zero), "docs": F.coalesce("docs", zero), "most_copies": F.coalesce("most_copies", F.lit(0)), "corpus_tokens": F.lit(total).cast("bigint")})
    return draw, report.withColumn("actual_share", F.coalesce(F.try_divide(F.col("drawn_tokens"), F.sum("drawn_tokens").over(Window.partitionBy())), F.lit(0.0)))
