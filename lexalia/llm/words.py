"""Texts of an Arrow batch as flat numpy arrays: words, word hashes, hashes of word spans.

The per-task helpers of the operators in this package. A batch is walked in slices of
about half a megabyte, so memory does not depend on how many rows Spark puts into a batch.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
_BYTES = np.arange(256)


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """Boolean table of the byte values within ``ranges`` (both ends included)."""
    return np.any([(_BYTES >= lo) & (_BYTES <= hi) for lo, hi in ranges], axis=0)


#: Words as runs of bytes outside ASCII white space.
SPACED = ~byte_set((0x20, 0x20), (0x09, 0x0D))
#: Words as runs of ASCII digits, ASCII letters and bytes of non-ASCII characters.
ALNUM = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Table that lower-cases A-Z only.
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
#: Bytes that begin a UTF-8 character.
LEADING = ~byte_set((0x80, 0xBF))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of ``batch`` holding about ``limit`` bytes of ``column``, or one longer row."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes, dtype=np.int64) // limit
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    for a, b in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(a, b - a)


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their offsets; null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true values that do not cross ``offsets``: starts, ends, first run of each part."""
    n = len(member)
    before = np.zeros(n + 1, bool)
    before[1:] = member
    before[offsets] = False
    after = np.zeros(n + 1, bool)
    after[:-1] = member
    after[offsets] = False
    starts = np.flatnonzero(member & ~before[:-1])
    ends = np.flatnonzero(member & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_KEPT = 1 << 19


@functools.cache
def _tables(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    out = []
    for value in (base, pow(base, -1, 1 << 64)):
        powers = np.full(size, value, np.uint64)
        powers[0] = 1
        out.append(np.cumprod(powers, dtype=np.uint64))
    return out[0], out[1]


def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """One kept table per base; longer ones are made for the occasion."""
    return _tables(base, _KEPT) if size <= _KEPT else _tables.__wrapped__(base, size)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of ``values[s:e]`` for each span, equal for equal content wherever it stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[:len(values)], dtype=np.uint64, out=sums[1:])
    size = (ends - starts).astype(np.uint64)
    return mix((sums[ends] - sums[starts]) * inverse[starts] + size * np.uint64(0x9E3779B97F4A7C15))


BYTE_BASE, BASE_A, BASE_B = 0x5851F42D4C957F2D, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25
_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_PIECE = 1 << 18


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of ``data[s:e]`` for ordered, disjoint spans; long inputs go piece by piece."""
    out, i = [], 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + _PIECE, "right")))
        part = _BYTE_VALUES[data[lo:ends[j - 1]]]
        out.append(span_hashes(part, starts[i:j] - lo, ends[i:j] - lo, BYTE_BASE))
        i = j
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


class Words:
    """The words of a slice of texts.

    ``data`` bytes, ``first`` index of each text's first word (one more at the end),
    ``start``/``end`` byte positions, ``hash`` 64-bit word hashes.
    """

    def __init__(self, texts: pa.Array, member: np.ndarray = SPACED, lower: bool = False):
        self.data, self.offsets = raw_bytes(texts)
        if lower:
            self.data = LOWER[self.data]
        self.start, self.end, self.first = runs(member[self.data], self.offsets)

    @functools.cached_property
    def hash(self) -> np.ndarray:
        return byte_hashes(self.data, self.start, self.end)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @functools.cached_property
    def doc(self) -> np.ndarray:
        """Number of the text each word stands in."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def windows(self, size: int) -> np.ndarray:
        """First words of all windows of ``size`` words within one text."""
        left = np.repeat(self.first[1:], self.counts) - np.arange(len(self.start))
        return np.flatnonzero(left >= size)

    def joined(self, a: int, b: int) -> bytes:
        """Words ``a`` to ``b`` (exclusive) joined by one space."""
        return b" ".join(self.data[self.start[a]:self.end[b - 1]].tobytes().split()) if b > a else b""

    def word(self, i: int) -> bytes:
        return self.data[self.start[i]:self.end[i]].tobytes()


def per_part(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` (booleans or integers) within each part of ``offsets``."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return np.diff(sums[offsets])


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """List array of ``values`` cut at ``offsets``."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
