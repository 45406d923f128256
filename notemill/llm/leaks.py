"""Evaluation texts leaking into training text: pigeonhole edit matching on words.

Documents and items are reduced to the same folded words: cue numbers, times, markup, sound descriptions, lines with a web or
mail address and repeated caption lines go; case and punctuation go; letters that recognition confuses are mapped to one.
Text that was UTF-8 and read as an 8-bit encoding is read again.  Accented Latin letters go (any wrong encoding loses them),
letters of all other scripts stay, without their marks; scripts written without spaces count each letter as a word.  Then, for
an item of W words:

1. a leak holds a stretch of H = ceil(W / 2) consecutive words of the item with at most E word edits.  The item is split into
   pieces of L = (H + 1) // (E + 2) words, so that every such stretch spans at least E + 1 whole pieces: one is unharmed;
2. documents are scanned for exact pieces, and around them for all runs of L words of the item: as an edit harms at most L runs, a
   stretch keeps H - L + 1 - L * E of them;
3. Myers' bit-parallel algorithm, over words and for all stretches of the item at once, tells where a stretch is within E
   edits of the document;
4. the words of the item that appear in order there are chained.  The item from the first to the last of them, and further
   where the next words look alike, must be ``COVER`` of it: a quotation that is merely completed by the error budget is no leak.

Steps 1 to 3 lose nothing.  The items travel to the workers in blocks of ``ITEMS``, each with a scan of the documents; nothing
grows with the corpus and no document is ever shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Word edits allowed in a stretch, as a share of its words; none in stretches below ``EXACT`` words.
ERRORS, EXACT = 0.4, 3
#: The least part of the item's words that the matched stretch spans.
COVER = 0.5
#: Items per scan of the documents.
ITEMS = 100_000
#: What a word left out, in the item or in the document, costs a chain of matching words.
GAP = 0.12
#: Bits of all stretches that are matched together.
BITS = 1 << 15

_TIME = re.compile(r"\d{1,2}\s*[:.]\s*\d{2}.{0,14}-+\s*>")
_NOISE = re.compile(r"<[^<>\n]{0,60}>|\{[^{}\n]{0,60}\}|\[[^\[\]\n]{0,80}\]|\([^()\n]{0,80}\)|\*[^*\n]{1,60}\*|(?:♪|♫|â\x99ª|â™ª|#)[^♪♫#\n]{0,60}?(?:♪|♫|â\x99ª|â™ª|#)")
_SPEAKER = re.compile(r"^\s*(?:>>+|-+)?\s*(?:[A-Z][A-Z0-9 .#']{1,24}:(?!\S))?")
#: A web or mail address: a dot or an at sign within a word.
_ADDRESS = re.compile(r"\w\.[a-z]{2,}|\w@\w|://")
#: Runs of the characters that the bytes of UTF-8 become when read as windows-1252 or latin-1.
_MISREAD = re.compile("[\u0080-ÿ" + bytes(x for x in range(0x80, 0xA0) if x not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)).decode("cp1252") + "]{2,}")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789|", b"abcdefghijklmnopqrstuvwxyzolzeasgtbgl")
_FOLD = bytes.maketrans(b"ihc", b"lbe")
_DROP = b"'`"
_BLANK = bytes.maketrans(bytes(x for x in range(128) if not (chr(x).isalnum() or chr(x) in "|'`")), b" " * sum(not (chr(x).isalnum() or chr(x) in "|'`") for x in range(128)))
_ASCII = bytes(range(128))
_WIDE = bytes(range(128, 256))
#: First and last code points of scripts written without spaces: Thai to Myanmar, Khmer, kana and Han.
_UNSPACED = ((0x0E00, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


class _Letters(dict):
    """What becomes of each character beyond ASCII, found out once for each."""

    def __missing__(self, code: int) -> str | int:
        self[code] = out = self._of(code)
        return out

    @staticmethod
    def _of(code: int) -> str | int:
        if code < 128:
            return code
        c = chr(code)
        if unicodedata.category(c)[0] == "Z" or c in "…–—":
            return " "
        if code < 0x370 or 0x1E00 <= code <= 0x1EFF or not c.isalnum():  # Latin letters with marks, and what is no letter
            return ""
        if any(a <= code <= b for a, b in _UNSPACED):
            return " " + " ".join(x for x in unicodedata.normalize("NFKD", c) if x.isalnum()) + " "
        if 0xAC00 <= code <= 0xD7A3:  # Hangul syllables stay whole
            return c
        plain = "".join(x for x in unicodedata.normalize("NFKD", c.casefold()) if x.isalnum())
        # full-width forms are Latin letters, other signs that spell Latin letters are none
        return plain if not plain.isascii() or 0xFF00 <= code <= 0xFFEF else ""


_LETTERS = _Letters()


def _read_again(m: re.Match[str]) -> str:
    try:
        return b"".join(c.encode("cp1252") if ord(c) > 255 else bytes([ord(c)]) for c in m[0]).decode("utf-8")
    except UnicodeDecodeError:
        return m[0]


def folded(text: str) -> list[bytes]:
    """The folded words of a text."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", _MISREAD.sub(_read_again, text)).translate(_LETTERS)
    b = text.encode("utf-8", "ignore")
    b = b.translate(_BLANK, _DROP).translate(_LOWER)
    # a sharp s is lost beyond ASCII, and its capital form is two letters; d is spelled out, for cl and el may both be one
    b = b.replace(b"ss", b"").replace(b"rn", b"m").replace(b"vv", b"w").replace(b"d", b"cl").translate(_FOLD)
    words = b.split()
    return words if b.isascii() else [w for w in map(_of_one_script, words) if w]


def _of_one_script(word: bytes) -> bytes:
    """A word of Latin and other letters is damaged: the lesser part goes."""
    plain = word.translate(None, _WIDE)
    return word if not plain or len(plain) == len(word) else plain if 2 * len(plain) >= len(word.decode("utf-8")) else word.translate(None, _ASCII)


def speech(text: str) -> list[bytes]:
    """The folded words that are spoken in a subtitle file, without what stands between them."""
    out: list[bytes] = []
    last: list[list[bytes]] = [[], []]
    for line in _NOISE.sub(" ", text).splitlines():
        s = line.strip()
        if not s or s.isdigit() or ("-" in s and ">" in s and _TIME.search(s)) or s.startswith(("WEBVTT", "NOTE ")):
            continue
        if ("." in s or "@" in s or ":" in s) and _ADDRESS.search(s):
            continue
        if s[0] in ">-" or ":" in s:
            s = _SPEAKER.sub("", s, count=1)
        words = folded(s)
        if not words:
            continue
        # a caption line shown again, perhaps read differently
        if any(len(words) == len(p) and 2 * sum(a == b for a, b in zip(words, p, strict=True)) >= len(p) and len(p) > 1 for p in last):
            last = [last[1], words]
            continue
        last = [last[1], words]
        out += words
    return out


class Stretches:
    """All stretches of ``half`` words of an item side by side in one bit vector, for Myers' algorithm.

    Each stretch has one bit per word and one above, where carries and shifts end.
    """

    def __init__(self, item: Sequence[int], half: int, budget: int, starts: range):
        self.half, wide = half, half + 1
        at = [wide * i for i in range(len(starts))]
        self.ones = sum(1 << x for x in at)
        self.body, self.guard = self.ones * ((1 << half) - 1), self.ones << half
        # a counter per stretch in the same bits; with this added its highest bit tells that it is above the budget
        self.above = self.ones * ((1 << half) - budget - 1)
        where: dict[int, int] = defaultdict(int)
        for i, w in enumerate(item):
            where[w] |= 1 << i
        one = (1 << half) - 1
        self.peq = {w: sum((m >> s & one) << x for s, x in zip(starts, at, strict=True)) for w, m in where.items()}

    def ends(self, text: Sequence[int]) -> list[int]:
        """The positions of ``text`` at which some stretch ends within the budget."""
        get, body, guard, ones, above, top = self.peq.get, self.body, self.guard, self.ones, self.above, self.half - 1
        vp, vn, score = body, 0, ones * self.half
        out = []
        for i, w in enumerate(text):
            eq = get(w, 0)
            xv = eq | vn
            xh = ((((eq & vp) + vp) ^ vp) | eq) & body
            hp = vn | body & ~(xh | vp)
            hn = vp & xh
            score += (hp >> top & ones) - (hn >> top & ones)
            if (score + above) & guard != guard:
                out.append(i)
            hp = hp << 1 & body
            vp = (hn << 1 & body) | body & ~(xv | hp)
            vn = hp & xv
        return out


def alike(a: bytes, b: bytes) -> bool:
    """Two folded words that differ in at most a third of their letters."""
    n = max(len(a), len(b))
    if a == b or n < 3 or abs(len(a) - len(b)) > n // 3:
        return a == b
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] <= n // 3


def budget_of(words: int, errors: float) -> tuple[int, int, int]:
    """(words of a stretch, its edits, words of a piece) of an item of so many words."""
    half = -(-words // 2)
    edits = int(errors * half) if half >= EXACT else 0
    return half, edits, max(1, (half + 1) // (edits + 2))


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _runs(ids: np.ndarray, length: int) -> np.ndarray:
    """A code for each run of ``length`` word numbers."""
    code = ids[: len(ids) - length + 1].astype(np.uint64)
    for i in range(1, length):
        code = code * _MIX + ids[i : len(ids) - length + 1 + i].astype(np.uint64)
    return code


class Matcher:
    """Finds the items of a block in documents."""

    def __init__(self, items: list[tuple[int, str]], errors: float = ERRORS, cover: float = COVER):
        self.cover = cover
        self.ids: list[int] = []
        self.words: list[list[bytes]] = []
        self.numbers: list[np.ndarray] = []
        self.size: list[tuple[int, int, int]] = []
        self.vocabulary: dict[bytes, int] = {}
        self.patterns: dict[int, list[Stretches]] = {}
        by_length: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = defaultdict(list)
        for item, text in items:
            ws = folded(text)
            if not ws:
                continue
            n = len(self.ids)
            size = budget_of(len(ws), errors)
            self.ids.append(item)
            self.words.append(ws)
            self.numbers.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws], np.int64))
            self.size.append(size)
            code = _runs(self.numbers[n], size[2])
            by_length[size[2]].append((code, np.full(len(code), n, np.int64), np.arange(len(code)) % size[2] == 0))
        #: For each length of pieces: the sorted codes of all runs, their items, and whether the run is a piece.
        self.runs = {}
        for length, parts in by_length.items():
            code, item, piece = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(code, kind="stable")
            self.runs[length] = code[order], item[order], piece[order]
        half, edits, length = (np.array(x, np.int64) for x in zip(*self.size, strict=True)) if self.size else (np.zeros(0, np.int64),) * 3
        self.span, self.need = half + edits - length, half - length + 1 - length * edits

    def found(self, words: list[bytes]) -> list[tuple[int, float]]:
        """(item id, covered share) of the items leaked in a document's words."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        out = []
        for length in self.runs:
            for n, lo, hi in self._regions(ids, length):
                share = self._verified(n, ids[lo:hi], words[lo:hi])
                if share >= self.cover:
                    out.append((self.ids[n], share))
        best: dict[int, float] = {}
        for i, c in out:
            best[i] = max(c, best.get(i, 0.0))
        return sorted(best.items())

    def _regions(self, ids: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
        """(item, from, to): parts of the document that hold a piece of the item and enough of its runs."""
        codes, items, pieces = self.runs[length]
        known = ids > 0
        whole = known[: max(0, len(ids) - length + 1)].copy()
        for i in range(1, length):
            whole &= known[i : len(whole) + i]
        pos = np.flatnonzero(whole)
        if not len(pos):
            return
        code = _runs(ids, length)[pos]
        a = np.searchsorted(codes, code)
        hit = codes[np.minimum(a, len(codes) - 1)] == code
        pos, code, a = pos[hit], code[hit], a[hit]
        if not len(pos):
            return
        many = np.searchsorted(codes, code, "right") - a
        entry = np.repeat(a - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
        item, pos, piece = items[entry], np.repeat(pos, many), pieces[entry]
        # one place counts once for an item, as a piece if any of its runs there is one
        far = len(ids) + int(self.span.max()) + 1
        key = item * far + pos
        order = np.lexsort((~piece, key))
        key, item, pos, piece = key[order], item[order], pos[order], piece[order]
        first = np.r_[True, key[1:] != key[:-1]]
        key, item, pos, piece = key[first], item[first], pos[first], piece[first]
        end = np.searchsorted(key, key + self.span[item], "right")
        at = np.arange(len(key))
        some = np.r_[0, np.cumsum(piece)]
        good = np.flatnonzero((end - at >= self.need[item]) & (some[end] > some[at]))
        n = lo = hi = -1
        for g in good:
            m, total = int(item[g]), len(self.numbers[item[g]])
            a, b = max(0, int(pos[g]) - total), min(len(ids), int(pos[end[g] - 1]) + length + total)
            if m == n and a <= hi:
                hi = max(hi, b)
                continue
            if n >= 0:
                yield n, lo, hi
            n, lo, hi = m, a, b
        if n >= 0:
            yield n, lo, hi

    def _stretches(self, n: int) -> Iterator[Stretches]:
        """Patterns of the item, kept where they are few."""
        item, (half, edits, _) = self.numbers[n].tolist(), self.size[n]
        most = max(1, BITS // (half + 1))
        starts = range(len(item) - half + 1)
        if len(starts) <= most:
            if n not in self.patterns:
                self.patterns[n] = [Stretches(item, half, edits, starts)]
            yield from self.patterns[n]
        else:
            for s in range(0, len(starts), most):
                yield Stretches(item, half, edits, starts[s : s + most])

    def _verified(self, n: int, ids: np.ndarray, words: list[bytes]) -> float:
        item, (half, edits, _) = self.numbers[n], self.size[n]
        # a stretch with at most so many edits keeps the rest of its words
        if np.isin(ids, item).sum() < half - edits:
            return 0.0
        text = ids.tolist()
        ends = sorted({e for s in self._stretches(n) for e in s.ends(text)})
        best, i = 0.0, 0
        while i < len(ends):
            j = i
            while j + 1 < len(ends) and ends[j + 1] - ends[j] <= len(item):
                j += 1
            lo, hi = max(0, ends[i] - len(item) - half), min(len(ids), ends[j] + len(item) + 1)
            best = max(best, self._covered(n, ids[lo:hi], words[lo:hi]))
            i = j + 1
        return best

    def _covered(self, n: int, ids: np.ndarray, words: list[bytes]) -> float:
        """The share of the item from the first to the last word of its best chain in a part of the document."""
        item, own = self.numbers[n], self.words[n]
        k, p = np.nonzero(item[:, None] == ids[None, :])
        if not len(k):
            return 0.0
        order = np.lexsort((k, p))
        k, p = k[order], p[order]
        score, first = np.ones(len(k)), np.arange(len(k))
        for a in range(1, len(k)):
            dk, dp = k[a] - k[:a], p[a] - p[:a]
            gain = np.where((dk > 0) & (dp > 0), score[:a] - GAP * (np.abs(dk - dp) + (dk - 1)), 0.0)
            b = int(gain.argmax())
            if gain[b] > 0:
                score[a], first[a] = 1 + gain[b], first[b]
        z = int(score.argmax())
        a = int(first[z])
        lo = self._further(own, words, int(k[a]), int(p[a]), -1)
        hi = self._further(own, words, int(k[z]), int(p[z]), 1)
        return (hi - lo + 1) / len(item)

    @staticmethod
    def _further(own: list[bytes], words: list[bytes], k: int, p: int, step: int) -> int:
        """How far the chain goes on with words that look alike, one word of the document being passed over at most."""
        while 0 <= k + step < len(own):
            for q in (p + step, p + 2 * step):
                if 0 <= q < len(words) and alike(own[k + step], words[q]):
                    k, p = k + step, q
                    break
            else:
                break
        return k


def leaks(docs: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str, errors: float = ERRORS, cover: float = COVER) -> DataFrame:
    """(doc, item, covered): each document that holds at least ``cover`` of an item as one passage.

    Null texts hold and are nothing, as are items without letters; an item of few words is common speech, and found wherever
    half of it is said; repeated items count once, repeated documents give repeated rows.
    """
    spark = docs.sparkSession
    rows = items.where(F.col(item_text).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t")).distinct()
    total = rows.count()
    out = spark.createDataFrame([], "doc bigint, item bigint, covered double")
    blocks = -(-total // ITEMS)
    for n in range(blocks):
        block = [(r["i"], r["t"]) for r in rows.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == n).collect()]
        found = docs.where(F.col(doc_text).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint"), F.col(doc_text)).mapInArrow(_scan(sorted(block), errors, cover), "doc bigint, item bigint, covered double")
        out = found if n == 0 else out.unionByName(found)
    return out


def _scan(block: list[tuple[int, str]], errors: float, cover: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(block, errors, cover)
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows += [(doc, i, c) for i, c in matcher.found(speech(text.as_py()))]
            cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["doc", "item", "covered"])

    return run
