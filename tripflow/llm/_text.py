"""Word and n-gram arithmetic on Arrow text buffers, one numpy pass per block of rows.

Texts stay UTF-8 bytes. A block is cut at row ends, so its working memory follows ``limit`` or, for a longer
text, that single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18

#: `[^\x20\x09-\x0D]` and `[0-9A-Za-z]` or any non-ASCII byte.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BYTE = np.random.default_rng(61).integers(0, 2**64, 256, dtype=np.uint64)
_MUL = 0x9E3779B97F4A7C15
_power: list[np.ndarray] = []


def _cumulated(m: int, n: int) -> np.ndarray:
    p = np.full(n, m, dtype=np.uint64)
    p[:1] = 1
    return np.cumprod(p, dtype=np.uint64, out=p)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _MUL and of its inverse. Those for a block are kept; a longer text gets its own."""
    both = _MUL, pow(_MUL, -1, 2**64)
    if n > 2 * BLOCK_BYTES:
        return _cumulated(both[0], n), _cumulated(both[1], n)
    if not _power:
        _power.extend(_cumulated(m, 2 * BLOCK_BYTES) for m in both)
    return _power[0][:n], _power[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the n + 1 row offsets into them; null is as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``limit`` bytes."""
    data, offsets = flat(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes in ``table``, and each row's first run (n + 1 of them)."""
    inside = table[data]
    before, after = np.zeros(len(data) + 1, dtype=bool), np.zeros(len(data) + 1, dtype=bool)
    before[1:], after[:-1] = inside, inside
    before[offsets], after[offsets] = False, False
    starts = np.flatnonzero(inside & ~before[:-1])
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the non-final-empty `\\n`-split lines, and each row's first line (n + 1)."""
    breaks = np.flatnonzero(data == 10)
    own = np.zeros(len(data) + 1, dtype=bool)
    own[offsets] = True
    inner = breaks[~own[breaks + 1]] + 1
    starts = np.sort(np.concatenate([offsets[:-1][np.diff(offsets) > 0], inner]))
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    ends = ends - (data[ends - 1] == 10) if len(starts) else ends
    return starts, ends, np.searchsorted(starts, offsets)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes."""
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * power[:-1], dtype=np.uint64, out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def gram_hash(word: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive word hashes; len(word) - k + 1 of them."""
    n = max(0, len(word) - k + 1)
    total = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        total = (total + word[i : i + n]) * np.uint64(_MUL)
    return mix(total)


def grams_in_rows(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the k-word windows that lie within a row, and their rows."""
    count = np.maximum(np.diff(first) - (k - 1), 0)
    row = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return first[:-1][row] + at, row


def per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of a mask over each row's bytes (or other items that offsets count)."""
    total = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Mask of 0..n-1 inside any of the intervals."""
    edge = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(ends, minlength=n + 1)[: n + 1]
    return np.cumsum(edge[:n]) > 0
