"""Vectorised word and phrase hashing of a batch of texts, used inside tasks.

A word is a maximal run of bytes other than blank, tab, LF, VT, FF and CR. All
work is done over one contiguous byte buffer for the whole Arrow batch, so the
cost is a few nanoseconds a byte and no Python object is made for each word.

Hashes are 64 bits wide: a polynomial over the bytes of a word modulo 2**64,
mixed, and combined over consecutive words. Users that need exactness compare
bytes afterwards or use two independent seeds (128 bits).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
CHUNK_BYTES = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the output."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


_KEPT: dict[int, np.ndarray] = {}


def _powers(n: int, base: np.uint64) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)``; those of a usual chunk are kept."""
    kept = _KEPT.get(int(base))
    if kept is None or len(kept) < n:
        kept = np.full(max(n, 1), base, dtype=np.uint64)
        kept[0] = 1
        kept = np.cumprod(kept, dtype=np.uint64)
        if n <= 2 * CHUNK_BYTES:
            _KEPT[int(base)] = kept
    return kept[:n]


_INV = np.uint64(pow(int(_R), -1, 1 << 64))
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """Words of a run of texts.

    ``start``/``end`` are byte offsets in ``data``; words of text ``i`` are
    ``first[i]:first[i + 1]``; ``hash`` is one 64-bit value for each word.
    """

    __slots__ = ("data", "end", "first", "hash", "start")

    def __init__(self, data, start, end, first, hashes):
        self.data, self.start, self.end, self.first, self.hash = data, start, end, first, hashes


@lru_cache(maxsize=8)
def _seed_table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed))


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = False, seed: int = 1, separators: np.ndarray = _IS_SPACE) -> Words:
    """Words of the texts ``data[offsets[i]:offsets[i + 1]]`` (uint8, ends included).

    ``separators`` says of each byte (after ``lower``) whether it stands between words.
    """
    base = int(offsets[0]) if len(offsets) else 0
    data = data[base : int(offsets[-1])] if len(offsets) else data[:0]
    offsets = np.asarray(offsets, dtype=np.int64) - base
    if lower:
        data = _LOWER[data]
    n = len(data)
    space = np.ones(n + 2, dtype=bool)
    space[1:-1] = separators[data]
    # A word starts where a text starts, too: texts lie side by side.
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    solid = ~space[1:-1]
    start = np.flatnonzero(solid & (space[:-2] | cut[:-1]))
    end = np.flatnonzero(solid & (space[2:] | cut[1:])) + 1
    if n:
        run = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_seed_table(seed)[data] * _powers(n, _R), out=run[1:], dtype=np.uint64)
        hashes = mix((run[end] - run[start]) * _powers(n, _INV)[start] + (end - start).astype(np.uint64))
    else:
        hashes = np.zeros(0, dtype=np.uint64)
    return Words(data, start, end, np.searchsorted(start, offsets), hashes)


def phrase_hashes(word_hash: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive words; entry ``i`` covers words ``i .. i + k - 1``.

    The caller masks out phrases that run over the end of a text.
    """
    n = len(word_hash) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = (out * _R) + word_hash[j : j + n]
    return mix(out)


def rolling_phrase_hashes(word_hash: np.ndarray, k: int) -> np.ndarray:
    """Like :func:`phrase_hashes` by prefix sums; the better one for large ``k``."""
    n = len(word_hash) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    run = np.zeros(len(word_hash) + 1, dtype=np.uint64)
    np.cumsum(word_hash * _powers(len(word_hash), _R), out=run[1:], dtype=np.uint64)
    return mix((run[k:] - run[:-k]) * _powers(n, _INV))


def least_in_runs(x: np.ndarray, k: int) -> np.ndarray:
    """Place of the leftmost least of ``x[i : i + k]`` for every ``i``, by doubling."""
    n = len(x) - k + 1
    at = np.arange(len(x))
    width = 1
    while width * 2 <= k:
        a, b = at[: len(at) - width], at[width:]
        at = np.where(x[b] < x[a], b, a)
        width *= 2
    a, b = at[:n], at[k - width : k - width + n]
    return np.where(x[b] < x[a], b, a)


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES):
    """Yields ``(row_from, row_to, data, offsets)`` for runs of rows of about ``limit`` bytes.

    Null texts count as empty. One text is never split, so a run holds at least
    one row however long that is.
    """
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        stop = min(n, max(stop, row + 1))
        yield row, stop, data, offsets[row : stop + 1]
        row = stop
