"""Long exact spans shared between records: a count-min prefilter over windows, then exact groups.

Two texts with a common substring of at least ``span`` code points select, by winnowing, the same k-gram at the same place of
it (k about span / 2).

1. The selected windows (hash, id, place) are made once and written, packed by cell: a shard of the hashes and a salt of the id.
2. Each cell is counted in a count-min sketch of its own; the sketches of a shard's cells are merged.  An estimate is never too
   low, and a window that a third of all records hold is spread over its shard's cells.
3. A second pass brings each cell's windows to the merged sketch of their shard and lets only those pass that are estimated to
   occur at least twice: all truly repeated ones are among them.
4. These fetch their surroundings from the texts and are grouped exactly; the common substring around the window is compared
   character by character.

Shards are as many as the corpus needs, so a sketch and a cell have the same size in a corpus of any size; nothing is sent to
the driver or broadcast.  Copies of whole texts are collapsed before (the report names each copy); a window that very many texts
share is handled by its whole spans (``HOT``), so that no list of a window is compared within one task.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notemill.llm.blocks import pairs_within
from notemill.llm.streams import groups
from notemill.llm.winnow import batches_of, code_points, mixed, winnowed
from notemill.session import cut

#: Rows of a sketch, counters in a row, windows that a shard should hold, and cells of a shard.
DEPTH, WIDTH, PER_SHARD, SALTS = 3, 1 << 22, 1 << 21, 8
#: Windows that a task packs at a time.
PACK = 1 << 20
#: Windows that more rows hold are grouped by whole spans instead of compared pair by pair.
HOT = 1000
#: Copies to be left out of the scans are broadcast up to this number of ids, else anti-joined by shuffle.
BROADCAST_IDS = 1_000_000


def _k(span: int) -> int:
    return span // 2 + 1


def _counters(h: np.ndarray) -> list[np.ndarray]:
    return [(mixed(h ^ np.uint64(0x9E3779B97F4A7C15 * (r + 1) % 2**64)) & np.uint64(WIDTH - 1)).astype(np.int64) for r in range(DEPTH)]


class Sketch:
    """A count-min sketch of two bits per counter: seen at least once, seen at least twice."""

    def __init__(self, data: bytes | None = None):
        bits = np.zeros(2 * DEPTH * WIDTH // 8, np.uint8) if data is None else np.frombuffer(zlib.decompress(data), np.uint8).copy()
        self.once, self.twice = bits.reshape(2, DEPTH, WIDTH // 8)

    def add(self, h: np.ndarray) -> None:
        for once, twice, counters in zip(self.once, self.twice, _counters(h), strict=True):
            at, n = np.unique(counters, return_counts=True)
            byte, bit = at >> 3, np.left_shift(1, at & 7).astype(np.uint8)
            again = ((once[byte] & bit) > 0) | (n > 1)
            np.bitwise_or.at(twice, byte[again], bit[again])
            np.bitwise_or.at(once, byte, bit)

    def merge(self, other: Sketch) -> None:
        self.twice |= other.twice | (self.once & other.once)
        self.once |= other.once

    def repeated(self, h: np.ndarray) -> np.ndarray:
        """Which windows are estimated to occur at least twice."""
        out = np.ones(len(h), bool)
        for twice, counters in zip(self.twice, _counters(h), strict=True):
            out &= (twice[counters >> 3] >> (counters & 7).astype(np.uint8) & 1) > 0
        return out

    def packed(self) -> bytes:
        return zlib.compress(np.concatenate([self.once, self.twice]).tobytes(), 1)


def _packed_windows(span: int, shards: int):
    """(shard, salt, wins, ids, places): the selected windows, packed by cell."""
    k, w = _k(span), span - _k(span) + 1

    def flush(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        h, ids, pos = (np.concatenate(x) for x in zip(*held, strict=True))
        shard = (h >> np.uint64(33)) % np.uint64(shards)
        cell = shard.astype(np.int64) * SALTS + (mixed(ids.astype(np.uint64)) % np.uint64(SALTS)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        h, ids, pos, cell = h[order], ids[order], pos[order], cell[order]
        at = np.r_[0, np.flatnonzero(cell[1:] != cell[:-1]) + 1, len(cell)]
        cuts = list(zip(at[:-1], at[1:], strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array((cell[at[:-1]] // SALTS).astype(np.int32)), pa.array((cell[at[:-1]] % SALTS).astype(np.int32)), *[pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for x in (h, ids, pos)]],
            ["shard", "salt", "wins", "ids", "places"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            every = b.column(0).to_numpy()
            for which, cp, starts in batches_of(b.column(1).to_pylist()):
                doc, at, h = winnowed(cp, starts, k, w)
                if len(h):
                    held.append((h, every[which][doc], (at - starts[doc]).astype(np.int32)))
                    size += len(h)
                if size >= PACK:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, sketch) of each cell in a stream sorted by cell; the windows pass by."""
    now, sketch = None, None
    for b in batches:
        for shard, salt, wins in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (shard, salt) != now:
                if now:
                    yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([sketch.packed()], pa.binary())], ["shard", "sketch"])
                now, sketch = (shard, salt), Sketch()
            sketch.add(np.frombuffer(wins, np.uint64))
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([sketch.packed()], pa.binary())], ["shard", "sketch"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sketch for each shard of a sorted stream, one part after the other."""
    now, sketch = None, None
    for b in batches:
        for shard, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if shard != now:
                if sketch:
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([sketch.packed()], pa.binary())], ["shard", "sketch"])
                now, sketch = shard, Sketch(data)
            else:
                sketch.merge(Sketch(data))
    if sketch:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([sketch.packed()], pa.binary())], ["shard", "sketch"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(win, id, pos) of the windows estimated to occur twice; each cell's sketch comes before its windows."""
    sketch = None
    for b in batches:
        for data, wins, ids, places in zip(*(b.column(c).to_pylist() for c in ("sketch", "wins", "ids", "places")), strict=True):
            if data is not None:
                sketch = Sketch(data)
                continue
            h = np.frombuffer(wins, np.uint64)
            keep = sketch.repeated(h)
            yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(np.frombuffer(ids, np.int64)[keep]), pa.array(np.frombuffer(places, np.int32)[keep])], ["win", "id", "pos"])


def repeated_windows(docs: DataFrame, span: int, windows: int) -> DataFrame:
    """(win, id, pos): the selected windows of (id, text) that may occur more than once; ``windows`` is about how many there are."""
    shards = max(1, -(-windows // PER_SHARD))
    packed = cut(docs.select("id", "text").mapInArrow(_packed_windows(span, shards), "shard int, salt int, wins binary, ids binary, places binary"), "spans-windows")
    cells = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(shards * SALTS, 100_000))
    parts = packed.select("shard", "salt", "wins").repartition(cells, "shard", "salt").sortWithinPartitions("shard", "salt").mapInArrow(_sketched, "shard int, sketch binary")
    merged = cut(parts.repartition(min(cells, shards), "shard").sortWithinPartitions("shard").mapInArrow(_merged, "shard int, sketch binary"), "spans-sketches")
    first = merged.select("shard", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(0).alias("k"), "sketch", *[F.lit(None).cast("binary").alias(c) for c in ("wins", "ids", "places")])
    both = first.unionByName(packed.select("shard", "salt", F.lit(1).alias("k"), F.lit(None).cast("binary").alias("sketch"), "wins", "ids", "places"))
    return both.repartition(cells, "shard", "salt").sortWithinPartitions("shard", "salt", "k").mapInArrow(_repeated, "win bigint, id bigint, pos int")


def _contexts(span: int):
    """(win, id, pos, lead, context): windows with the text around them, from (id, text, at: [(win, pos)])."""
    k = _k(span)
    side = span - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wins, ids, places, context = [], [], [], []
            for i, text, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for x in at:
                    p = x["pos"]
                    wins.append(x["win"])
                    ids.append(i)
                    places.append(p)
                    context.append(text[max(0, p - side) : p + k + side])
            yield pa.RecordBatch.from_arrays(
                [pa.array(wins, pa.int64()), pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array([min(p, side) for p in places], pa.int32()), pa.array(context, pa.string())], ["win", "id", "pos", "lead", "context"]
            )

    return run


def _compared(span: int):
    """Pairs (a, b) and covered ranges (a, null, from, to) of the rows of one window."""
    k = _k(span)
    side = span - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for _, t in groups(batches, ["win"]):
            ids, pos, lead = t.column("id").to_numpy(), t.column("pos").to_numpy(), t.column("lead").to_numpy()
            n = len(ids)
            if n < 2 or (ids == ids[0]).all():
                continue
            # each context with its window at column ``side``; what lies outside a text equals nothing
            m = -np.repeat(np.arange(1, n + 1, dtype=np.int64)[:, None], k + 2 * side, axis=1)
            for i, c in enumerate(t.column("context").to_pylist()):
                m[i, side - lead[i] : side - lead[i] + len(c)] = code_points(c)
            lo, hi = np.full(n, side), np.full(n, side + k)
            hit = np.zeros(n, bool)
            pairs = set()
            for i in range(n - 1):
                same = m[i + 1 :] == m[i]
                left = np.where(same[:, :side].all(1), side, (~same[:, :side][:, ::-1]).argmax(1))
                right = np.where(same[:, side + k :].all(1), side, (~same[:, side + k :]).argmax(1))
                ok = same[:, side : side + k].all(1) & (left + right >= side) & (ids[i + 1 :] != ids[i])
                for d in np.flatnonzero(ok):
                    j = i + 1 + d
                    pairs.add((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
                    hit[i] = hit[j] = True
                    for x in (i, j):
                        lo[x], hi[x] = min(lo[x], side - left[d]), max(hi[x], side + k + right[d])
            out += [(a, b, None, None) for a, b in sorted(pairs)]
            out += [(int(ids[x]), None, int(pos[x] - side + lo[x]), int(pos[x] - side + hi[x])) for x in np.flatnonzero(hit)]
            if len(out) > 20_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], ["a", "b", "start", "end"])


def _whole_spans(span: int):
    """All spans of exactly ``span`` characters around hot windows, by their digest."""
    k = _k(span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = b.to_pydict()
            rows = []
            for i, p, lead, c in zip(d["id"], d["pos"], d["lead"], d["context"], strict=True):
                for s in range(max(0, lead - (span - k)), min(lead, len(c) - span) + 1):
                    rows.append((hashlib.md5(c[s : s + span].encode("utf-8", "surrogatepass")).digest(), i, p - lead + s))
            if rows:
                x = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x[0], pa.binary()), pa.array(x[1], pa.int64()), pa.array(x[2], pa.int32())], ["digest", "a", "start"])

    return run


def shared_spans(docs: DataFrame, id_col: str, text_col: str, span: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, pairs, covered) of the common substrings of at least ``span`` code points.

    members: (id, class, n) for each record of at least ``span`` code points; records of one class have equal texts, and its
    least id stands for it.  pairs: (a, b), a < b, between representatives.  covered: (a, start, end), ranges of a
    representative's text whose union is all that it shares with other classes.
    Null and shorter texts share nothing; of repeated ids with different texts the greatest digest counts.
    """
    if span < 8:
        raise ValueError("the span must be at least 8")
    spark = docs.sparkSession
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    rows = rows.where(F.length("text") >= span)
    marks = cut(rows.groupBy("id").agg(F.max(F.struct(F.unhex(F.md5("text")).alias("class"), F.length("text").alias("n"))).alias("m")).select("id", "m.class", "m.n"), "spans-members")
    first = marks.groupBy("class").agg(F.min("id").alias("id"), F.first("n").alias("n"))
    chars = first.agg(F.sum("n")).first()[0]
    none = spark.createDataFrame([], "a bigint, b bigint, start int, end int")
    if not chars:
        return marks, none.select("a", "b"), none.select("a", "start", "end")
    windows = chars * 2 // (span - _k(span) + 2) + 1
    spare = marks.select("id").join(first.select("id"), "id", "left_anti")
    spare = F.broadcast(spare) if spare.count() <= BROADCAST_IDS else spare
    unique = rows.join(spare, "id", "left_anti")
    again = repeated_windows(unique, span, windows).groupBy("id").agg(F.collect_list(F.struct("win", "pos")).alias("at"))
    found = cut(unique.join(again, "id").select("id", "text", "at").mapInArrow(_contexts(span), "win bigint, id bigint, pos int, lead int, context string"), "spans-found")
    hot = found.groupBy("win").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > HOT).select("win")
    cold = found.join(hot, "win", "left_anti").repartition("win").sortWithinPartitions("win", "id", "pos").mapInArrow(_compared(span), "a bigint, b bigint, start int, end int")
    cold = cut(cold, "spans-pairs")
    wide = cut(found.join(hot, "win", "left_semi").select("id", "pos", "lead", "context").mapInArrow(_whole_spans(span), "digest binary, a bigint, start int").distinct(), "spans-wide")
    hot_pairs = pairs_within(wide.select("digest", "a").distinct(), "digest", "a")
    twice = wide.groupBy("digest").agg(F.min("a").alias("low"), F.max("a").alias("high")).where("low < high").select("digest")
    hot_cover = wide.join(twice, "digest", "left_semi").select("a", "start", (F.col("start") + span).alias("end"))
    pairs = cold.where(F.col("b").isNotNull()).select("a", "b").unionByName(hot_pairs).distinct()
    covered = cold.where(F.col("b").isNull()).select("a", "start", "end").unionByName(hot_cover).distinct()
    return marks, pairs, covered


def covered_chars(covered: DataFrame) -> DataFrame:
    """(a, shared): the length of the union of a record's ranges."""
    before = Window.partitionBy("a").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    return covered.withColumn("fresh", fresh).groupBy("a").agg(F.sum("fresh").alias("shared"))
