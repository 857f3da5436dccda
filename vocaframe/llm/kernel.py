"""Vectorised text kernels used inside Arrow-batched tasks.

All of them work on the UTF-8 bytes of a slice of a batch, a few megabytes at
a time, so that memory stays bounded whatever the size of a batch; a single
very long text is processed whole, alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
CHUNK_ROWS = 2048

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def _lut(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


#: ASCII white space: U+0020 and U+0009 to U+000D.
SPACE = _lut(bytes([0x20, *range(0x09, 0x0E)]))
#: Everything in ASCII that is neither letter nor digit.
NOT_WORD = _lut(bytes(c for c in range(128) if not chr(c).isalnum()))
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32


class _Powers:
    """Powers of the hash base and of its inverse, grown when a longer text comes."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << max(n - 1, 1 << 16).bit_length()
            for name, base in (("up", _BASE), ("down", _INV)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))
        return cls.up, cls.down


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) for runs of at most ``CHUNK_ROWS`` rows
    of about ``limit`` bytes; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1, at + 1)
        end = min(end, at + CHUNK_ROWS, len(column))
        yield at, data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
        at = end


def range_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = FOLD) -> np.ndarray:
    """64-bit hash of each byte range, equal for equal folded bytes."""
    return ranges_hash(prefix_sums(data, fold), starts, ends)


def prefix_sums(data: np.ndarray, fold: np.ndarray = FOLD) -> np.ndarray:
    """Sums that :func:`ranges_hash` takes hashes of ranges from."""
    up, _ = _Powers.get(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_TABLE[fold][data] * up[:len(data)], out=sums[1:])
    return sums


def ranges_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """:func:`range_hash` of bytes whose prefix sums are known."""
    _, down = _Powers.get(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row plus the total): maximal runs of
    bytes that are no separators; a run never crosses rows."""
    if not len(data):
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(offsets), np.int64)
    word = ~separators[data]
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = word[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    before[inner] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = word[1:]
    inner = offsets[1:][offsets[1:] > 0] - 1
    after[inner] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of each row plus the total)."""
    starts, ends, first = word_spans(data, offsets, separators)
    return range_hash(data, starts, ends), first


_STEP = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of ``width`` consecutive words of one text; a shorter text is one
    shingle, a text without words none."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(width, n)
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out += hashes[i:n - k + 1 + i] * _STEP[i]
    return mix(out + np.uint64(k))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    if len(values) > 1:
        values = values[np.concatenate(([True], values[1:] != values[:-1]))]
    return values


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.uint64)


def set_hash(values: np.ndarray) -> np.uint64:
    """One hash for a set given as sorted distinct hashes."""
    with np.errstate(over="ignore"):
        return mix(np.array([values.sum(dtype=np.uint64) * _STEP[1] + np.uint64(len(values))], np.uint64) ^ np.bitwise_xor.reduce(mix(values), initial=np.uint64(0)))[0]
