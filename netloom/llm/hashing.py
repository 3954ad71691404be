"""Vectorised 64-bit hashes of the words of Arrow string batches.

A word's hash depends on its bytes alone, so every executor gets the same
value.  Bytes are read straight from the Arrow buffers in blocks of about
BLOCK bytes, cut between documents or, inside a longer one, at white space,
so memory doesn't grow with the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values."""
    x = x.astype(U, copy=True)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(_BASE, 1 << 12)
_INV = _powers(pow(_BASE, -1, 1 << 64), 1 << 12)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        n = 1 << (n - 1).bit_length()
        _POW, _INV = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
    return _POW, _INV


_FOLD = np.arange(256, dtype=U) + U(1)
_FOLD[65:91] += U(32)
SPACES = np.zeros(256, dtype=bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True


#: All bytes but letters and those of characters beyond ASCII.
NOT_LETTERS = np.ones(256, dtype=bool)
NOT_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _block_words(data: np.ndarray, cuts: np.ndarray, between: np.ndarray, prefix: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and starts of the words of data, and hashes of their first ``prefix`` bytes (0 for words no longer); cuts: where a text begins."""
    space = between[data]
    starts = ~space
    starts[1:] &= space[:-1]
    cuts = cuts[cuts < len(data)]
    starts[cuts] = ~space[cuts]
    at = np.flatnonzero(starts)
    if not len(at):
        return np.empty(0, U), at, np.empty(0, U)
    power, inverse = _tables(len(data))
    value = _FOLD[data]
    value *= power[: len(data)]
    value[space] = 0
    sums = np.add.reduceat(value, at)
    stems = np.zeros(len(at) if prefix else 0, U)
    if prefix:
        longer = np.flatnonzero(np.add.reduceat((~space).astype(np.int64), at) > prefix)
        for j in range(prefix):
            stems[longer] += _FOLD[data[at[longer] + j]] * power[j]
        stems[longer] = mix(stems[longer] ^ U(0xA0761D6478BD642F))
    return mix(sums * inverse[at]), at, stems


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _long_words(data: np.ndarray, between: np.ndarray, prefix: int) -> np.ndarray:
    out, a = [], 0
    while a < len(data):
        b = min(len(data), a + BLOCK)
        while b < len(data) and not between[data[b]]:
            gap = np.flatnonzero(between[data[b : b + 4096]])
            b = b + int(gap[0]) if len(gap) else min(len(data), b + 4096)
        hashes, _, stems = _block_words(data[a:b], np.zeros(1, np.int64), between, prefix)
        out += [hashes, stems[stems != 0]]
        a = b
    return np.concatenate(out) if out else np.empty(0, U)


def word_hashes(column: pa.Array, between: np.ndarray = SPACES, prefix: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of its lower-cased words in order) for each row of a string column.

    between: the bytes that part words; with a prefix, hashes of the first so many bytes of longer words are among them.
    """
    data, offsets = text_buffers(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK, side="right")) - 1)
        a, b = offsets[row], offsets[end]
        if end == row + 1 and b - a > BLOCK:
            yield row, _long_words(data[a:b], between, prefix)
        elif b == a:
            for r in range(row, end):
                yield r, np.empty(0, U)
        else:
            hashes, at, stems = _block_words(data[a:b], offsets[row:end] - a, between, prefix)
            edges = np.searchsorted(at, offsets[row : end + 1] - a)
            for r in range(row, end):
                own = slice(edges[r - row], edges[r - row + 1])
                yield r, np.concatenate([hashes[own], stems[own][stems[own] != 0]]) if prefix else hashes[own]
        row = end


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of fewer words, the whole sequence is one."""
    if not len(words):
        return np.empty(0, U)
    if len(words) < k:
        h = np.array([len(words)], dtype=U)
        for i in range(len(words)):
            h = mix(h * U(0xBF58476D1CE4E5B9) + words[i : i + 1])
        return h
    n = len(words) - k + 1
    h = np.zeros(n, dtype=U)
    for i in range(k):
        h = h * U(0xC2B2AE3D27D4EB4F) + words[i : i + n]
    return np.unique(mix(h))
