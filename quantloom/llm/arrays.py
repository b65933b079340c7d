"""Texts of an Arrow batch as flat NumPy arrays: words, word hashes, rolling hashes and winnowed positions.

All functions run inside Spark tasks. They work on one chunk of documents (`chunks`), so that memory follows the chunk size, and the longest
single document, not the batch. Hashes are 64-bit polynomials over a random table with an odd base, finished by a mixing step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
SPACES = (9, 10, 11, 12, 13, 32)

_BASE = 0x9E3779B97F4A7C15  # odd and 5 modulo 8
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_IS_SPACE = np.isin(np.arange(256), SPACES)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[:] = out
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def prefix(symbols: np.ndarray) -> np.ndarray:
    """Prefix sums of symbol * base**i, one longer than `symbols`; `spans` reads hashes of any span from it."""
    out = np.empty(len(symbols) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(symbols * powers(len(symbols) + 1)[0][: len(symbols)], out=out[1:])
    return out


def spans(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of symbols[start:end], equal for equal symbols wherever they stand."""
    return mix((pre[end] - pre[start]) * powers(len(pre))[1][start] + (end - start).astype(np.uint64))


def grams(pre: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive symbols."""
    n = len(pre) - k
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    return mix((pre[k:] - pre[:n]) * powers(len(pre))[1][:n])


def byte_symbols(data: np.ndarray) -> np.ndarray:
    return _TABLE[data]


def chunks(text: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows with about `size` bytes; a null counts as empty."""
    text = text.cast(pa.large_binary())
    if text.null_count:
        text = text.fill_null(b"")
    n = len(text)
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64, count=text.offset + n + 1)[text.offset:] if n else np.zeros(1, dtype=np.int64)
    values = text.buffers()[2]
    data = np.frombuffer(values, dtype=np.uint8) if values is not None and values.size else np.empty(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII white space, never across documents), and the index of each document's first word."""
    n = len(data)
    solid = ~_IS_SPACE[data]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets[:-1]] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | first[1:n]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | first[1:n]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, and the index of each document's first word (one longer than the documents)."""
    starts, ends, first = word_bounds(data, offsets)
    return spans(prefix(_TABLE[data]), starts, ends), first


def sliding(values: np.ndarray, w: int, pick=np.minimum) -> np.ndarray:
    """Minimum (or maximum) of every w consecutive values."""
    out, have = values, 1
    while have < w:
        step = min(have, w - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


def winnowed(hashes: np.ndarray, first: np.ndarray, w: int) -> np.ndarray:
    """Whether a position is the least of some w consecutive ones of its document (all ties count). `first`: each document's first index.

    Two equal runs of w hashes have an equal selected position, wherever they stand. Documents with fewer than w hashes select nothing.
    """
    n = len(hashes)
    chosen = np.zeros(n, dtype=bool)
    if n < w:
        return chosen
    value = (hashes >> np.uint64(33)).astype(np.uint32)
    least = sliding(value, w)
    inside = np.zeros(n + 1, dtype=np.int32)  # windows that cross into the next document hold nothing
    for a, b in ((np.maximum(first[:-1], 0), first[1:]),):
        ok = b - a >= w
        np.add.at(inside, a[ok], 1)
        np.add.at(inside, b[ok] - w + 1, -1)
    least = np.where(np.cumsum(inside[: len(least)]) > 0, least, np.uint32(0))
    pad = np.zeros(w - 1, dtype=np.uint32)
    most = sliding(np.concatenate([pad, least, pad]), w, np.maximum)
    chosen = (value == most) & (np.cumsum(inside[:n]) >= 0)
    # a document that has no whole window sees only zeros; a real value of zero there must not count
    length = np.repeat(np.diff(first), np.diff(first))
    return chosen & (length >= w)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges start, start + 1, ... of the given lengths."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
