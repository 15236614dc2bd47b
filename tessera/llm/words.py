"""Vectorised words and rolling hashes over Arrow text columns.

A batch of texts is one byte buffer with offsets.  Words are runs of bytes of a given class, so a word
never crosses a document.  Hashes are Rabin-Karp polynomials modulo 2**64 over values drawn at random
per byte; with an odd base every hash of a slice is a difference of prefix sums, so that one cumulative
sum gives the hashes of all slices.  Such sums tell long sequences of regular build (Thue-Morse words) apart badly,
so words of more than LONG_WORD bytes are hashed by XXH3 one by one, and sequences() hashes whole sequences by place.  Buffers are worked through in segments of a few MB, cut at
separators, so that memory does not follow the length of one text.
"""

from __future__ import annotations

import ctypes
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SEGMENT, LONG_WORD = 2 << 20, 64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)
BYTE_VALUES = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)


def _class(excluded: list[tuple[int, int]]) -> np.ndarray:
    table = np.ones(256, bool)
    for low, high in excluded:
        table[low : high + 1] = False
    return table


#: Words [^\x20\x09-\x0D]+ and [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ as byte classes; multi-byte characters are in both.
SPACED = _class([(0x20, 0x20), (0x09, 0x0D)])
ALNUM_LOWER = _class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32
ALNUM = ALNUM_LOWER[LOWER]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse modulo 2**64."""
    global _POW, _INV
    if len(_POW) < n:
        size = 1 << (n - 1).bit_length()

        def grow(base: int) -> np.ndarray:
            out = np.ones(1, np.uint64)
            while len(out) < size:
                out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
            return out

        _POW, _INV = grow(_BASE), grow(pow(_BASE, -1, 1 << 64))
    return _POW[:n], _INV[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which span() takes hashes of slices."""
    p, _ = _powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * p[:-1], out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each slice start:end of the values behind the prefix sums."""
    _, inv = _powers(len(sums))
    return (sums[end] - sums[start]) * inv[start]


def rolling(values: np.ndarray, n: int) -> np.ndarray:
    """Rabin-Karp hash of every n consecutive values."""
    if len(values) < n:
        return np.zeros(0, np.uint64)
    sums = prefix(values)
    _, inv = _powers(len(sums))
    return mix((sums[n:] - sums[:-n]) * inv[: len(values) - n + 1])


def sequences(values: np.ndarray, first: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each whole sequence first[i]:first[i + 1]: a sum of values mixed with their places, 0 for an empty one."""
    count = np.diff(first)
    place = np.arange(len(values), dtype=np.uint64) - np.repeat(first[:-1], count).astype(np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values ^ mix(place + np.uint64(mix_seed(seed)))), dtype=np.uint64)))
    return np.where(count > 0, mix(sums[first[1:]] - sums[first[:-1]] + count.astype(np.uint64)), np.uint64(0))


def mix_seed(seed: int) -> int:
    return (seed * 0xD1342543DE82EF95 + _BASE) & _MASK


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # index of each text's first word, and the number of words
    buffer: np.ndarray
    offsets: np.ndarray

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def of(self, i: int) -> slice:
        return slice(self.first[i], self.first[i + 1])


def tokenize(buffer: np.ndarray, offsets: np.ndarray, kind: np.ndarray = SPACED, fold: np.ndarray = SAME, hashes: bool = True) -> Words:
    """Words of all texts: byte positions in the buffer and 64-bit hashes of the folded bytes."""
    starts, ends, found, at, n = [], [], [], 0, len(buffer)
    values = BYTE_VALUES[fold]
    while at < n:
        to = min(n, at + SEGMENT)
        while to < n and kind[buffer[to]] and not (k := np.flatnonzero(~kind[buffer[to : to + 4096]])).size:
            to += 4096
        if to < n and kind[buffer[min(to, n - 1)]]:
            to += int(np.flatnonzero(~kind[buffer[to : to + 4096]])[0])
        to = min(to, n)
        part = buffer[at:to]
        inside = kind[part]
        cuts = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, to, "left")] - at
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        before[cuts] = False
        after = np.empty_like(inside)
        after[-1], after[:-1] = False, inside[1:]
        after[cuts - 1] = False
        s, e = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        if hashes:
            own = mix(span(prefix(values[part]), s, e))
            for i in np.flatnonzero(e - s > LONG_WORD).tolist():
                own[i] = xxhash.xxh3_64_intdigest(fold[part[s[i] : e[i]]].tobytes())
            found.append(own)
        starts.append(s + at)
        ends.append(e + at)
        at = to
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    start = join(starts, np.int64)
    return Words(join(found, np.uint64), start, join(ends, np.int64), np.searchsorted(start, offsets, "left"), buffer, offsets)


def batches(column: pa.Array, limit: int = SEGMENT):
    """Ranges of rows whose texts hold about limit bytes together; one long text is a range of its own."""
    _, offsets = text_buffer(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to
        at = to


def release() -> None:
    """Give freed memory back to the system, as workers live on and share a machine with others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def within(first: np.ndarray, n: int, count: int) -> np.ndarray:
    """Which of the count slices of n words lie in one text."""
    ok = np.ones(max(count, 0), bool)
    for back in range(1, n):
        edge = first[1:-1] - back
        edge = edge[(edge >= 0) & (edge < len(ok))]
        ok[edge] = False
    return ok
