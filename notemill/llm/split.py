"""Splitting oversized texts at natural boundaries.

Each text becomes an array of unit offsets (prefix sums of the size of its characters in the unit that the limit is
stated in) and sorted arrays of boundary positions.  From a start s, binary search in the offsets gives the last
position within the limit, binary search in the boundaries the last boundary up to there; the next piece starts
``overlap`` units before the cut.  Where a window has no boundary, the cut is hard, but not within a character and,
where possible, not before a combining mark.

Kinds of boundary, best first: after a blank line, after a line end, after the end of a sentence, after white space.
A better kind is taken if it fills at least half of the window; else the last boundary of any kind that leaves more than
the overlap; else the hard cut.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.functions.compat import col, utf16_length

UNITS = ("chars", "utf8_bytes", "utf16_units")
_KINDS = [re.compile(p) for p in (r"\n[^\S\n]*\n\s*", r"\r\n|\n|\r", r"[.!?…。！？]+[\"'”’»)\]]*\s+", r"\s+")]


def measured(text: Column | str, unit: Column | str) -> Column:
    """The size of a text in code points, UTF-8 bytes or UTF-16 units; null for a null text or an unknown unit."""
    t, u = col(text), col(unit)
    return (
        F.when(u == "chars", F.length(t).cast("bigint"))
        .when(u == "utf8_bytes", F.octet_length(t).cast("bigint"))
        .when(u == "utf16_units", utf16_length(t))
    )


def _offsets(text: str, unit: str) -> np.ndarray:
    """offsets[i]: the size of text[:i]."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    width = np.ones(len(cp), np.int64)
    if unit == "utf8_bytes":
        width += (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
    elif unit == "utf16_units":
        width += cp >= 0x10000
    return np.r_[0, np.cumsum(width)]


def cut_text(text: str, unit: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) code-point ranges of the pieces of ``text``, each at most ``limit`` units (unless one character alone
    is larger), consecutive ones sharing at least ``overlap`` units (and less than one character more).

    A text within the limit is one piece, also the empty text.  limit must be positive and overlap below it.  Every
    piece adds text; where the overlap and one more character exceed the limit, the overlap gives way.
    """
    if limit <= 0 or not 0 <= overlap < limit:
        raise ValueError("need 0 <= overlap < limit")
    off = _offsets(text, unit)
    n = len(text)
    if off[n] <= limit:
        return [(0, n)]
    kinds = [np.array([m.end() for m in k.finditer(text)], np.int64) for k in _KINDS]
    every = np.unique(np.concatenate(kinds))
    pieces: list[tuple[int, int]] = []
    start = done = 0
    while True:
        if done < n:
            start = min(done, max(start, int(np.searchsorted(off, off[done + 1] - limit, "left"))))
        if off[n] - off[start] <= limit:
            pieces.append((start, n))
            return pieces
        first = done + 1
        last = max(first, int(np.searchsorted(off, off[start] + limit, "right")) - 1)
        half = max(first, int(np.searchsorted(off, off[start] + limit // 2, "left")))
        end = _last(kinds, half, last) or _last([every], first, last)
        if not end:
            end = last
            while first < end < n and unicodedata.combining(text[end]):
                end -= 1
            if end < n and unicodedata.combining(text[end]):
                end = last
        pieces.append((start, end))
        if end == n:
            return pieces
        done = end
        start = max(start + 1, int(np.searchsorted(off, off[end] - overlap, "right")) - 1)


def _last(kinds: list[np.ndarray], low: int, high: int) -> int:
    """The last boundary within low..high of the first kind that has one, or 0."""
    for bounds in kinds:
        i = int(np.searchsorted(bounds, high, "right")) - 1
        if i >= 0 and bounds[i] >= low:
            return int(bounds[i])
    return 0


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("_row", pa.int64()), ("piece_ix", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("piece", pa.string())])
    for b in batches:
        out: list[tuple] = []
        cols = b.to_pydict()
        rows = zip(cols["_row"], cols["_text"], cols["_unit"], cols["_limit"], cols["_overlap"], strict=True)
        for row, text, unit, limit, overlap in rows:
            out += [(row, k, s, e, text[s:e]) for k, (s, e) in enumerate(cut_text(text, unit, limit, overlap))]
        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out, strict=True) if out else [[]] * 5, schema, strict=True)], schema=schema)


def split_oversized(items: DataFrame, key: list[str], text: str, limit: str, unit: str, overlap: str) -> DataFrame:
    """(*key, size, oversized, piece_ix, start, end, piece): the pieces of every item, in order of piece_ix.

    ``key`` identifies an item; rows with the same key must agree and give repeated pieces.  Items within the limit
    pass through the JVM as their own single piece; only oversized ones visit Python.  A null text has no pieces.  A
    null or unknown unit or a null limit means no limit; a null overlap is 0, one not below the limit is limit - 1.
    """
    t = items.select(
        *key, F.col(text).alias("_text"), F.col(unit).alias("_unit"), F.col(limit).cast("int").alias("_limit"), F.coalesce(F.col(overlap).cast("int"), F.lit(0)).alias("_overlap")
    ).where(F.col("_text").isNotNull())
    t = t.withColumn("size", F.coalesce(measured("_text", "_unit"), F.length("_text").cast("bigint")))
    over = F.coalesce((F.col("size") > F.col("_limit")) & F.col("_unit").isin(*UNITS) & (F.col("_limit") > 0), F.lit(False))
    t = t.withColumn("oversized", over).withColumn("_overlap", F.greatest(F.lit(0), F.least("_overlap", F.col("_limit") - 1)))
    whole = t.where("NOT oversized").select(
        *key, "size", "oversized", F.lit(0).alias("piece_ix"), F.lit(0).alias("start"), F.length("_text").alias("end"), F.col("_text").alias("piece")
    )
    # the keys ride along as one struct, so names in them cannot clash
    big = t.where("oversized").select(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(key)], F.col("size").alias("size")).alias("_key"), "_text", "_unit", "_limit", "_overlap")
    kind = big.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # in slices, for a batch may hold very long texts
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = part.drop_columns(["_key"]).append_column("_row", pa.array(np.arange(part.num_rows)))
                for done in _pieces(iter([rows])):
                    ix = done.column(0)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(ix), *done.columns[1:]], ["_key", "piece_ix", "start", "end", "piece"])

    cut = big.mapInArrow(run, f"_key {kind}, piece_ix int, start int, end int, piece string")
    cut = cut.select(*[F.col(f"_key.k{i}").alias(c) for i, c in enumerate(key)], F.col("_key.size").alias("size"), F.lit(True).alias("oversized"), "piece_ix", "start", "end", "piece")
    return whole.unionByName(cut)
