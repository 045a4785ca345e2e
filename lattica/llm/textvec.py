"""Whole columns of text as numpy arrays: word hashes, shingle sets and set sums, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text worked on at once (a single longer text is worked on alone); arrays take up to some 60 times as much.
SLICE_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The characters that end a word: space and 0x09 to 0x0D.
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
#: All ASCII bytes but letters; bytes of longer UTF-8 characters count as letters.
NO_LETTER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers whose every output bit depends on every input bit."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0x9FB21C651E98DF25)
    return x ^ (x >> U(32))


@lru_cache(1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


BASE = 0x5851F42D4C957F2D
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the power 0 to n, and the inverses modulo 2**64."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            x = np.full(max(n, SLICE_BYTES) + 1, base, U)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, nulls as empty, and where each row begins (with the end)."""
    column = column.cast(pa.large_binary()).fill_null(b"") if column.null_count else column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)), at - at[0]


def slices(at: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with up to so many bytes each, or a single row."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j
        i = j


def spans(data: np.ndarray, at: np.ndarray, ends: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, end) of every word in order; ends: which bytes stand between words."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    blank = ends[data]
    before = np.concatenate(([True], blank[:-1]))
    before[at[:-1][at[:-1] < len(data)]] = True
    after = np.concatenate((blank[1:], [True]))
    after[(at[1:] - 1)[at[1:] > 0]] = True
    start, end = np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1
    return np.searchsorted(at, start, "right") - 1, start, end


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of pieces of data, A-Z in lower case."""
    if not len(start):
        return np.zeros(0, U)
    up, down = powers(len(data))
    total = np.concatenate((np.zeros(1, U), np.cumsum(_byte_values()[LOWER[data]] * up[: len(data)], dtype=U)))
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U))


def words(data: np.ndarray, at: np.ndarray, ends: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit hash) of every word, A-Z in lower case, in order; ends: which bytes stand between words."""
    row, start, end = spans(data, at, ends)
    return row, hashes(data, start, end)


def shingles(row: np.ndarray, word: np.ndarray, k: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (row, hash) of every run of k words; of a row with fewer words, one of them all."""
    n = np.bincount(row, minlength=rows)
    first = np.concatenate(([0], np.cumsum(n)))[:-1]
    place = np.arange(len(row)) - first[row]
    full = place <= n[row] - k
    at = np.flatnonzero(full)
    h = np.zeros(len(at), U)
    for j in range(k):
        h = (h + word[at + j]) * U(0xBF58476D1CE4E5B9) ^ (h >> U(31))
    r = row[at]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        s = np.zeros(len(short), U)
        for j in range(k - 1):
            more = j < n[short]
            w = word[np.minimum(first[short] + j, len(word) - 1)]
            s = np.where(more, (s + w) * U(0x94D049BB133111EB) ^ (s >> U(31)), s)
        r, h = np.concatenate((r, short)), np.concatenate((h, s + n[short].astype(U)))
    h = mix(h)
    order = np.lexsort((h, r))
    r, h = r[order], h[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    return r[new], h[new]


def sums(index: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """For each index below n, a 64-bit hash of the multiset of its numbers h; 0 where there are none.

    Sums of halves of 32 bits stay exact as doubles up to 2**21 numbers an index.
    """
    lo = np.bincount(index, (h & U(0xFFFFFFFF)).astype(np.float64), n).astype(U)
    hi = np.bincount(index, (h >> U(32)).astype(np.float64), n).astype(U)
    return mix(lo * U(0x9E3779B97F4A7C15) + mix(hi)) * (np.bincount(index, minlength=n) > 0)
