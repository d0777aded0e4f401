"""Hashed words and shingles of texts, in numpy, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Odd numbers; the first is the base of the words' polynomial.
_BASE = 0x9E3779B97F4A7C15
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)
_MASK = (1 << 64) - 1

# One 64-bit number for each byte value, from a splitmix sequence; A to Z take those of a to z.
_BYTES = np.zeros(256, dtype=np.uint64)
_state = 1
for _i in range(256):
    _state = (_state + _BASE) & _MASK
    _z = ((_state ^ (_state >> 30)) * _MIX[0]) & _MASK
    _z = ((_z ^ (_z >> 27)) * _MIX[1]) & _MASK
    _BYTES[_i] = _z ^ (_z >> 31)
_BYTES[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True

_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def _grow(n: int) -> None:
    """Tables of the base's powers and of their inverses modulo 2**64."""
    global _powers, _inverse
    while len(_powers) < n:
        size = len(_powers)
        _powers = np.concatenate([_powers, _powers * _U(pow(_BASE, size, 1 << 64))])
        _inverse = np.concatenate([_inverse, _inverse * _U(pow(pow(_BASE, -1, 1 << 64), size, 1 << 64))])


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a hash over all of it."""
    h = (h ^ (h >> _U(30))) * _U(_MIX[0])
    h = (h ^ (h >> _U(27))) * _U(_MIX[1])
    return h ^ (h >> _U(31))


#: Bytes of text that are hashed at once.
CHUNK = 1 << 20


def batch_words(column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For consecutive runs of rows of an Arrow string column: the first row, the words' hashes, and where each row's words begin, with their number at the end."""
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + CHUNK, side="right")) - 1)
        stop = min(stop, n)
        part = raw[ends[row] : ends[stop]]
        starts = ends[row : stop + 1] - ends[row]
        size = len(part)
        _grow(size + 1)
        inside = ~_SPACE[part]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        heads = starts[:-1][(starts[:-1] < size)]
        first[heads] = inside[heads]
        begin = np.flatnonzero(first)
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        tails = starts[1:][(starts[1:] > 0)] - 1
        last[tails] = inside[tails]
        end = np.flatnonzero(last) + 1
        total = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(_BYTES[part] * _powers[:size], out=total[1:])
        hashes = mix((total[end] - total[begin]) * _inverse[begin] + (end - begin).astype(np.uint64))
        yield row, hashes, np.searchsorted(begin, starts)
        row = stop


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    h = np.full(max(len(hashes) - k + 1, 0), k, dtype=np.uint64)
    for i in range(k):
        h = mix(h * _U(_MIX[2]) + hashes[i : len(hashes) - k + 1 + i])
    return h


def batch_shingles(column, n: int) -> Iterator[np.ndarray]:
    """For every row of an Arrow string column the distinct hashes, sorted, of its runs of n words; of the whole text where it has fewer; none without words or text."""
    for _, hashes, begin in batch_words(column):
        whole = runs(hashes, n)
        for a, b in zip(begin[:-1], begin[1:], strict=True):
            if b - a >= n:
                yield np.unique(whole[a : b - n + 1])
            else:
                yield runs(hashes[a:b], int(b - a)) if b > a else hashes[:0]
