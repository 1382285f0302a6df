"""Vectorised words of Arrow text columns: offsets and 64-bit hashes without a Python object per word.

A word is a maximal run of bytes other than space and tab..carriage return, with A-Z lower-cased.  All
functions work on whole texts; they take the rows of a batch in groups of about ``GROUP_BYTES``, so memory
follows that size or, beyond it, the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

GROUP_BYTES = 1 << 20

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_RADIX = 0x9E3779B97F4A7C15
_INVERSE = pow(_RADIX, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, GROUP_BYTES + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size > 8 * GROUP_BYTES:  # a text this long is rare: do not keep its table
            return have
        _POWERS[base] = have
    return have


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column and its row offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def row_groups(offsets: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes together; a longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; ``offsets`` are the row offsets within ``data``."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_SEPARATOR[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the lower-cased bytes of each span."""
    return span_hasher(data)(starts, ends)


def span_hasher(data: np.ndarray):
    """A function from spans of ``data`` to the hashes of their lower-cased bytes."""
    powers = _powers(_RADIX, len(data) + 1)
    terms = _LOWER[data].astype(np.uint64)
    terms += np.uint64(1)
    terms *= powers[: len(data)]
    prefix = np.empty(len(data) + 1, np.uint64)
    prefix[0] = 0
    np.cumsum(terms, out=prefix[1:])
    inverse = _powers(_INVERSE, len(data) + 1)
    return lambda starts, ends: mix64((prefix[ends] - prefix[starts]) * inverse[starts])


def word_groups(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, word hashes, bounds of each row's words) for groups of rows."""
    data, offsets = text_bytes(column)
    for first, last in row_groups(offsets):
        part = offsets[first : last + 1] - offsets[first]
        view = data[offsets[first] : offsets[last]]
        starts, ends = word_spans(view, part)
        yield first, last, span_hashes(view, starts, ends), np.searchsorted(starts, part)


def shingles(words: np.ndarray, bounds: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` following words and the row of each; a shorter text gives its whole sequence as one."""
    counts = np.diff(bounds)
    odd = np.arange(1, 2 * width, 2, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    found, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    if len(words) >= width:
        n = len(words) - width + 1
        rolled = np.zeros(n, np.uint64)
        for k in range(width):
            rolled += mix64(words[k : k + n] ^ odd[k])
        row = np.repeat(np.arange(len(counts)), counts)
        whole = row[:n] == row[width - 1 :]
        found.append(mix64(rolled[whole]))
        rows.append(row[:n][whole])
    for row in np.flatnonzero((counts > 0) & (counts < width)):
        own = words[bounds[row] : bounds[row + 1]]
        total = mix64(own ^ odd[: len(own)]).sum(keepdims=True) + np.uint64(len(own))
        found.append(mix64(total ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
        rows.append(np.array([row], np.int64))
    return np.concatenate(found), np.concatenate(rows)


def distinct_shingles(words: np.ndarray, bounds: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each row's shingle set, sorted, and the bounds of the rows."""
    found, rows = shingles(words, bounds, width)
    order = np.lexsort((found, rows))
    found, rows = found[order], rows[order]
    if len(found):
        fresh = np.empty(len(found), bool)
        fresh[0] = True
        fresh[1:] = (found[1:] != found[:-1]) | (rows[1:] != rows[:-1])
        found, rows = found[fresh], rows[fresh]
    return found, np.searchsorted(rows, np.arange(len(bounds)))
