"""Words of whole Arrow columns as NumPy arrays: bounds, hashes and rolling hashes, with no step per word in Python.

A word is a longest run of bytes other than space and \\t to \\r. A hash is a sum of byte or word values times powers of an odd
number, modulo 2^64, read off running sums; equal words have equal hashes whatever stands around them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
ODD = {"byte": 0x9E3779B97F4A7C15, "short": 0xC2B2AE3D27D4EB4F, "long": 0xD6E8FEB86659FD93, "check": 0xA0761D6478BD642F, "gram": 0xE7037ED1A0B428DB}
BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(odd: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of odd and of its inverse modulo 2^64; the longest run of them asked for is kept."""
    if odd not in _POWERS or len(_POWERS[odd][0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())

        def run(x: int) -> np.ndarray:
            out = np.full(size, x, np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        _POWERS[odd] = run(odd), run(pow(odd, -1, 1 << 64))
    return tuple(p[:n] for p in _POWERS[odd])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column, and each row's offsets; a null is an empty text."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array | pa.ChunkedArray) -> list[pa.Array]:
    return column.chunks if isinstance(column, pa.ChunkedArray) else [column]


def slices(offsets: np.ndarray, most: int = BLOCK):
    """Row ranges of about `most` bytes; a longer row stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and each row's first word (rows + 1 values)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    black = ~WHITE[data]
    fresh = np.ones(len(data) + 1, bool)
    fresh[1:-1] = ~black[:-1]
    fresh[offsets] = True
    starts = np.flatnonzero(black & fresh[:-1])
    fresh[:-1] = ~black
    fresh[offsets] = True
    ends = np.flatnonzero(black & fresh[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, computed over blocks of bytes."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + BLOCK, "right")))
        high = ends[j - 1]
        up, down = powers(ODD["byte"], high - low)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data[low:high]] * up, out=sums[1:])
        s = starts[i:j] - low
        out[i:j] = (sums[ends[i:j] - low] - sums[s]) * down[s]
        i = j
    return mix(out)


def rolling(hashes: np.ndarray, n: int, odd: int) -> np.ndarray:
    """A hash of each n consecutive words, by first word; len(hashes) - n + 1 values, rows not regarded."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    up, down = powers(odd, len(hashes))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up, out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[: len(hashes) - n + 1])


def whole(firsts: np.ndarray, n: int) -> np.ndarray:
    """Which n-word windows, by first word, lie in one row."""
    total = int(firsts[-1])
    if total < n:
        return np.zeros(0, bool)
    ends = np.repeat(firsts[1:], np.diff(firsts))[: total - n + 1]
    return np.arange(total - n + 1) + n <= ends
