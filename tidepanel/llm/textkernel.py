"""Vectorised text kernels shared by the operators on word shingles and word n-grams.

They run on the bytes of an Arrow string column: words are maximal runs of bytes other
than \\x20 and \\x09-\\x0D, which in UTF-8 are exactly the words ``[^\\x20\\x09-\\x0D]+`` of the
text. A word's 64-bit hash is a polynomial over random byte values, taken from prefix sums,
so that hashing costs a few array passes and no Python call per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes of text that one array pass works on; longer texts are passes of their own.
SLICE_BYTES = 512 << 10

_byte_values: dict[bool, np.ndarray] = {}
_powers = [np.ones(1, _U), np.ones(1, _U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _values(lower: bool) -> np.ndarray:
    if lower not in _byte_values:
        of = np.arange(256)
        if lower:
            of[ord("A") : ord("Z") + 1] += 32
        _byte_values[lower] = mix(of.astype(_U) * _U(0xD1B54A32D192ED03) + _U(0x8CB92BA72F3D8DD7))
    return _byte_values[lower]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) pieces of about ``most`` bytes, whole rows each."""
    raw, at = text_bytes(column)
    first, rows = 0, len(at) - 1
    while first < rows:
        end = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield first, end, raw[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def word_bounds(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and per row the index of its first word (with a last end)."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~SPACE[raw]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = at[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    starts[edges] |= inside[edges]
    ends[edges - 1] |= inside[edges - 1]
    start = np.flatnonzero(starts)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, at, "left")


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    if not len(start):
        return np.zeros(0, _U)
    up, down = _power(len(raw) + 1)
    total = np.zeros(len(raw) + 1, _U)
    np.cumsum(_values(lower)[raw] * up[:-1], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(_U))


def fold(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive words, by the index of their first."""
    if len(words) < n:
        return np.zeros(0, _U)
    total = np.full(len(words) - n + 1, n, _U)
    for i in range(n):
        total += words[i : len(words) - n + 1 + i] * mix(np.array([i + 1], _U) * _BASE)[0]
    return mix(total)


def shingle_sets(raw: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    """Per row its sorted distinct n-word shingles; with fewer words the whole sequence as one."""
    start, end, first = word_bounds(raw, at)
    words = word_hashes(raw, start, end, lower=True)
    runs = fold(words, n)
    found = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            found.append(np.unique(runs[a : b - n + 1]))
        elif b > a:
            found.append(fold(words[a:b], b - a))
        else:
            found.append(np.zeros(0, _U))
    return found
