"""Words and word shingles of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

import functools
import hashlib

import numpy as np

K = 5
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
#: Powers that are kept: enough for the texts of a step and some more.
KEPT = 1 << 20
_NEXT = np.uint64(0xD6E8FEB86659FD93)
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that mixes all bits (splitmix64's last steps)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of _ODD and of its inverse; those that usual steps need are kept."""
    return tuple(x[:n] for x in _kept_powers()) if n <= KEPT else (_power_row(_ODD, n), _power_row(_INVERSE, n))


def _power_row(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p, out=p)


@functools.cache
def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return _power_row(_ODD, KEPT), _power_row(_INVERSE, KEPT)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased, split at ASCII white space) of all texts in a row, and where each text's words start.

    The second array has one entry more than there are texts.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(x) + 1 for x in raw]) if raw else np.zeros(0, np.int64)
    data = _LOW[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
    gap = _GAP[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.r_[0, edge]
    start, end = edge[::2], edge[1::2]
    up, down = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up, out=total[1:])
    words = scramble((total[end] - total[start]) * down[start])
    return words, np.r_[0, np.searchsorted(start, ends)].astype(np.int64)


def shingle_hashes(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the k-word shingles of one text's words, in order; of all words as one where they are fewer."""
    n = len(words)
    if n == 0:
        return words
    m = min(k, n)
    out = np.full(n - m + 1, np.uint64(m), np.uint64)
    for j in range(m):
        out = out * _NEXT + words[j : n - m + 1 + j]
    return scramble(out)


def rolling_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one text's words, in order, in a few steps whatever k is; none where they are fewer."""
    n = len(words)
    if n < k:
        return words[:0]
    up, down = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up, out=total[1:])
    return scramble((total[k:] - total[:-k]) * down[: n - k + 1])


def digest(sorted_set: np.ndarray) -> bytes:
    return hashlib.blake2b(sorted_set.tobytes(), digest_size=16).digest()
