"""Hashes of the words of many texts at once, on numpy arrays.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D of the UTF-8 text, which is the same as the pattern
``[^\\x20\\x09-\\x0D]+`` on code points.  Word hashes are 64-bit multilinear hashes with pseudo-random coefficients.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 400_000
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_coefficients = np.zeros(0, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _coefficient(n: int) -> np.ndarray:
    global _coefficients
    if len(_coefficients) < n:
        _coefficients = mix(np.arange(max(n, 256), dtype=np.uint64) * np.uint64(3) + np.uint64(12345)) | np.uint64(1)
    return _coefficients


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column in one array, and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges (from, to) of at most ``limit`` bytes, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def hash_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start, end) of every word of all rows; start and end are byte positions in ``data``.

    ``space`` tells which bytes separate words.
    """
    parts, n = [], len(data)
    rows = offsets[:-1][np.diff(offsets) > 0]
    begin = 0
    while begin < n:
        # a row longer than a block is cut at white space, so that no array here is much longer than a block
        end = n if n - begin <= 2 * BLOCK_BYTES else begin + BLOCK_BYTES
        if end < n:
            later = np.flatnonzero(space[data[end : end + BLOCK_BYTES]])
            end = end + int(later[0]) + 1 if len(later) else n
        piece = data[begin:end]
        inside = ~space[piece]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        heads = rows[(rows >= begin) & (rows < end)] - begin
        first[heads] = inside[heads]
        starts = np.flatnonzero(first)
        if len(starts):
            at = np.flatnonzero(inside)
            word_first = np.searchsorted(at, starts)
            lengths = np.diff(np.append(word_first, len(at)))
            within = np.arange(len(at)) - np.repeat(word_first, lengths)
            letters = piece[at]
            if lower:
                letters = _LOWER[letters]
            terms = (letters.astype(np.uint64) + np.uint64(1)) * _coefficient(int(lengths.max()))[within]
            parts.append((mix(np.add.reduceat(terms, word_first) + lengths.astype(np.uint64)), starts + begin, starts + begin + lengths))
        begin = end
    if not parts:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    hashes, starts, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
    return hashes, np.searchsorted(offsets, starts, "right") - 1, starts, ends


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` words; with fewer words, one hash of the whole sequence (none without words)."""
    if not len(words):
        return words
    size = min(size, len(words))
    out = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        out += words[k : len(words) - size + 1 + k] * (mix(np.uint64([k + 77]))[0] | np.uint64(1))
    return mix(out + np.uint64(size))
