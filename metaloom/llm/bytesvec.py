"""Vectorised text primitives over Arrow batches.

A text column is handled as one UTF-8 byte buffer plus row offsets. Words are
the maximal runs of bytes other than ASCII white space (tab, line feed,
vertical tab, form feed, carriage return, space); each has a 64-bit hash from two
prefix-summed polynomials, so a batch costs a few numpy passes and no Python
object per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy pass holds; a longer single text is handled whole.
SLICE_BYTES = 1 << 19
#: Two primes and a base for each: a hash is a pair of polynomials modulo these.
_PRIMES = (2147483647, 2147483629)
_BASES = (1297834573, 1783920611)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_pow: dict[tuple[int, bool], np.ndarray] = {}


def powers(which: int, n: int, inverse: bool = False) -> np.ndarray:
    """``base ** i`` (or its inverse) modulo the prime for i in 0..n, kept between calls while small."""
    have = _pow.get((which, inverse))
    if have is None or len(have) <= n:
        p = _PRIMES[which]
        base = pow(_BASES[which], -1, p) if inverse else _BASES[which]
        size = max(n + 1, SLICE_BYTES + 1)
        have = np.ones(size, dtype=np.uint64)
        done = 1
        while done < size:
            to = min(2 * done, size)
            have[done:to] = have[: to - done] * np.uint64(pow(base, done, p)) % np.uint64(p)
            done = to
        if size <= 4 * SLICE_BYTES:
            _pow[which, inverse] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scramble of 64-bit integers (splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _spans(term: np.ndarray, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of each term[start:end], shifted to begin at power 0, modulo the prime. The sum of all terms is below 2**64."""
    p = np.uint64(_PRIMES[which])
    acc = np.zeros(len(term) + 1, dtype=np.uint64)
    np.cumsum(term, out=acc[1:])
    return (acc[end] - acc[start]) % p * powers(which, len(term), inverse=True)[start] % p


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each ``data[start:end]``, equal for equal bytes.

    Polynomials modulo two primes: texts built to defeat arithmetic modulo 2**64
    have no hold on it. Unequal spans of n bytes meet with a chance of about (n / 2**31)**2.
    """
    n, both = len(data), []
    value = data.astype(np.uint64) + np.uint64(1)
    for which, p in enumerate(_PRIMES):
        term = value * powers(which, n)[:n]
        if n > 1 << 24:
            term %= np.uint64(p)
        both.append(_spans(term, which, start, end))
    return mix((both[0] << np.uint64(32)) | both[1])


def window_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each run ``values[start:end]`` of 64-bit values, as ``span_hash``."""
    n, both = len(values), []
    for which, p in enumerate(_PRIMES):
        term = values % np.uint64(p) + np.uint64(1)
        term *= powers(which, n)[:n]
        term %= np.uint64(p)
        both.append(_spans(term, which, start, end))
    return mix((both[0] << np.uint64(32)) | both[1])


@dataclass
class Slice:
    """Rows ``first..first+rows`` of a batch as bytes with row offsets from 0."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def text(self, row: int) -> str:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes().decode("utf-8", "replace")


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte buffer and int64 row offsets of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(wide)
    if column.null_count:
        column = column.fill_null(b"" if wide == pa.large_binary() else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    d = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The rows in order, in pieces of at most ``limit`` bytes or one row."""
    data, offs = column_bytes(column)
    at, n = 0, len(offs) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
        to = min(to, n)
        yield Slice(at, data[offs[at] : offs[to]], offs[at : to + 1] - offs[at])
        at = to


def pieces(s: Slice, rows: int) -> Iterator[Slice]:
    """A slice in pieces of at most so many rows."""
    for at in range(0, s.rows, rows):
        o = s.offsets[at : at + rows + 1]
        yield Slice(s.first + at, s.data[o[0] : o[-1]], o - o[0])


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    #: first word of each row, with the total at the end
    bounds: np.ndarray


def words(s: Slice, hashed: bool = True) -> Words:
    """Words of every row of a slice, in order."""
    space = _SPACE[s.data]
    solid = np.zeros(len(s.data) + 2, dtype=bool)
    solid[1:-1] = ~space
    begins = solid[1:-1] & ~solid[:-2]
    ends = solid[1:-1] & ~solid[2:]
    edge = s.offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(s.data))]
    if len(edge):  # a row's end also ends a word
        begins[edge[solid[1:-1][edge]]] = True
        last = edge - 1
        ends[last[solid[1:-1][last]]] = True
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    row = np.searchsorted(s.offsets, start, side="right") - 1
    bounds = np.searchsorted(row, np.arange(s.rows + 1))
    h = span_hash(s.data, start, end) if hashed else np.zeros(0, np.uint64)
    return Words(start, end, row, h, bounds)


def ragged_ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenation of ``range(start[i], start[i] + length[i])``."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(length) - length
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(start, np.int64) - first, length)


def united(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Labels after joining p[i] with q[i]; a label is the least number of its group."""
    while True:
        x, y = label[p], label[q]
        differ = x != y
        if not differ.any():
            return label
        np.minimum.at(label, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while not np.array_equal(after := label[label], label):
            label = after


def list_array(flat: np.ndarray, length: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Arrow list column from flat values and row lengths."""
    offs = np.zeros(len(length) + 1, dtype=np.int32)
    np.cumsum(length, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(flat).cast(kind) if pa.array(flat[:0]).type != kind else pa.array(flat))


def binary_array(data: np.ndarray, length: np.ndarray) -> pa.Array:
    """Arrow binary column from flat bytes and row lengths."""
    offs = np.zeros(len(length) + 1, dtype=np.int32)
    np.cumsum(length, out=offs[1:])
    return pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(data))])


class HashIndex:
    """Open-addressing map from 64-bit hash to a dense number, all in numpy."""

    def __init__(self, bits: int = 16):
        self._reset(bits)

    def _reset(self, bits: int) -> None:
        self.bits, self.size = bits, 0
        self.keys = np.zeros(1 << bits, dtype=np.uint64)
        self.vals = np.full(1 << bits, -1, dtype=np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each hash, -1 where unknown."""
        mask = np.int64((1 << self.bits) - 1)
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.vals[slot]
        todo = np.flatnonzero((out >= 0) & (self.keys[slot] != h))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & mask
            out[todo] = self.vals[slot[todo]]
            todo = todo[(out[todo] >= 0) & (self.keys[slot[todo]] != h[todo])]
        return out

    def add(self, h: np.ndarray) -> None:
        """Number distinct, unknown hashes from ``size`` on, in order."""
        if (self.size + len(h)) * 2 > 1 << self.bits:
            used = np.flatnonzero(self.vals >= 0)
            k, v = self.keys[used], self.vals[used]
            bits = self.bits
            while (self.size + len(h)) * 2 > 1 << bits:
                bits += 1
            size = self.size
            self._reset(bits)
            self._place(k, v)
            self.size = size
        self._place(h, np.arange(self.size, self.size + len(h), dtype=np.int32))
        self.size += len(h)

    def _place(self, h: np.ndarray, v: np.ndarray) -> None:
        mask = np.int64((1 << self.bits) - 1)
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            free = self.vals[slot[todo]] < 0
            t = todo[free]
            self.vals[slot[t]] = v[t]
            self.keys[slot[t]] = h[t]
            won = np.zeros(len(h), dtype=bool)
            won[t[self.vals[slot[t]] == v[t]]] = True
            todo = todo[~won[todo]]
            slot[todo] = (slot[todo] + 1) & mask
