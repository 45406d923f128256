"""Windows of text: hashes of all k-grams of many texts at once, and the windows that winnowing selects."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        p = np.full(size, base, np.uint64)
        p[0] = 1
        have = _POWERS[base] = np.cumprod(p)
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit codes."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def gram_hashes(cp: np.ndarray, k: int) -> np.ndarray:
    """One 64-bit hash for each k-gram of ``cp``: polynomial prefix sums modulo 2^64, scrambled."""
    n = len(cp)
    if n < k:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    # a character's code is scrambled first, so that simple arithmetic relations between characters do not collide
    np.cumsum(mixed(cp.astype(np.uint64) + np.uint64(0x51ED27)) * _powers(_BASE, n), out=sums[1:])
    return mixed((sums[k:] - sums[: n + 1 - k]) * _powers(_INVERSE, n + 1 - k))


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """min(h[i : i + w]) for each i with a whole window, by block-wise running minima."""
    n = len(h)
    if n < w:
        return h[:0]
    pad = -n % w
    x = np.concatenate([h, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    left = np.minimum.accumulate(x, axis=1).ravel()
    right = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def batches_of(texts: Sequence[str | None], most: int = 1_000_000) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(indices, code points, start of each) of consecutive texts joined up to about ``most`` characters."""
    held: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        if not t:
            continue
        held.append(i)
        size += len(t)
        if size >= most:
            yield _joined(texts, held)
            held, size = [], 0
    if held:
        yield _joined(texts, held)


def _joined(texts: Sequence[str | None], which: list[int]) -> tuple[list[int], np.ndarray, np.ndarray]:
    lens = np.array([len(texts[i]) for i in which], np.int64)
    return which, code_points("".join(texts[i] for i in which)), np.r_[0, np.cumsum(lens)]


def winnowed(cp: np.ndarray, starts: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position in ``cp``, hash) of the selected k-grams of several joined texts.

    Of every w consecutive k-grams of one text all with the least hash are selected, so two texts with a common
    substring of at least w + k - 1 characters select the same k-gram at the same place of it.  k-grams that cross from
    one text to the next are never selected; texts of fewer than w k-grams select nothing.
    """
    h = gram_hashes(cp, k)
    if len(h) < w:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), h[:0]
    low = sliding_min(h, w)
    # windows that lie within one text
    text_of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    good = text_of[: len(low)] == text_of[w + k - 2 : w + k - 2 + len(low)]
    # h[i] is selected if it is the least of a good window that holds it: the greatest of those windows' minima
    peak = np.where(good, low, np.uint64(0))
    pad = np.concatenate([np.zeros(w - 1, np.uint64), peak, np.zeros(w - 1, np.uint64)])
    most = ~sliding_min(~pad, w)
    at = np.flatnonzero(most[: len(h)] == h)
    at = at[h[at] > 0]
    return text_of[at], at, h[at]
