"""Vectorised byte-level text helpers for the Arrow functions of this subpackage.

Everything here works on one flat ``uint8`` buffer plus document offsets, so a batch of documents is
handled by a fixed number of numpy passes instead of a Python loop over documents or words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes between words: [\x20\x09-\x0D].
SEP = np.zeros(256, bool)
SEP[[9, 10, 11, 12, 13, 32]] = True
#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RNG = np.random.Generator(np.random.PCG64(20240607))
#: One fixed random 64-bit value per byte value; the alphabet of the polynomial word hash.
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE**0 .. BASE**(n-1) modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(max(n, 64), BASE, np.uint64)
        p[0] = 1
        _POWERS = np.cumprod(p, dtype=np.uint64)
    return _POWERS[:n]


_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_INVERSES = np.ones(1, np.uint64)


def inverse_powers(n: int) -> np.ndarray:
    """BASE**0 .. BASE**-(n-1) modulo 2**64."""
    global _INVERSES
    if len(_INVERSES) < n:
        p = np.full(max(n, 64), _INVERSE, np.uint64)
        p[0] = 1
        _INVERSES = np.cumprod(p, dtype=np.uint64)
    return _INVERSES[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift), so that close inputs give unrelated outputs."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def flat(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its rows; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if bufs[2] is None else np.frombuffer(bufs[2], np.uint8)[offs[0] : offs[-1]]
    return data, offs - offs[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``limit`` bytes of text each (one row at least), to bound memory."""
    _, offs = flat(batch.column(column))
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def words(data: np.ndarray, offs: np.ndarray, sep: np.ndarray = SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes outside sep, and for each document the index of its first (n + 1 values).

    By default the words [^\\x20\\x09-\\x0D]+.
    """
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    solid = np.zeros(len(data) + 2, np.int8)
    np.logical_not(sep[data], out=solid[1:-1].view(bool))
    step = np.diff(solid)
    # Words that meet at a document's edge are two: an end and a start stand at one place there.
    inner = offs[(offs > 0) & (offs < len(data))]
    inner = inner[(solid[inner] == 1) & (solid[inner + 1] == 1)]
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if len(inner):
        inner = np.unique(inner)
        starts, ends = np.sort(np.concatenate((starts, inner))), np.sort(np.concatenate((ends, inner)))
    return starts, ends, np.searchsorted(starts, offs)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int = 1 << 16) -> np.ndarray:
    """64-bit hash of each byte span (differences of a running polynomial); spans must be in order and not overlap, and may not be empty."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + limit, "right")))
        part = data[low : ends[to - 1]]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTE[part] * powers(len(part)), out=total[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mix((total[e] - total[s]) * inverse_powers(len(part) + 1)[s] + (e - s).astype(np.uint64))
        at = to
    return out


def spans_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as an Arrow large_binary array."""
    lens = ends - starts
    offs = np.concatenate(([0], np.cumsum(lens))).astype(np.int64)
    at = np.arange(int(offs[-1]), dtype=np.int64) + np.repeat(starts - offs[:-1], lens)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(data[at].tobytes())])


def segment_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i+1]]; empty segments give 0."""
    total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]
