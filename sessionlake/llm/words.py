"""Words, shingles and their 64-bit hashes for whole Arrow columns of texts, without a Python loop over texts or words.

A word is a run of bytes other than space and tab..carriage return; A-Z are lower-cased. All hashes are sums of random byte
weights times powers of an odd base modulo 2**64, taken from prefix sums, and mixed afterwards. They depend on the text
alone: not on the batch, the task, or the interpreter's hash seed.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_CHUNK = 1 << 20

_weights = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_weights[65:91] = _weights[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: np.uint64, count: int) -> np.ndarray:
    out = np.full(count, base, dtype=np.uint64)
    if count:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


class Words(NamedTuple):
    """hashes, starts and ends (bytes in buffer) of all words; first[i]:first[i+1] are the words of text i."""
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    buffer: np.ndarray
    offsets: np.ndarray


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and their n + 1 offsets; null is an empty text."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    array = array.fill_null("").cast(pa.large_string())
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset:array.offset + len(array) + 1]
    buffer = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buffer[offsets[0]:offsets[-1]], offsets - offsets[0]


def words(column, spaces: bytes = b"") -> Words:
    """All words; bytes of `spaces` separate words too."""
    buffer, offsets = text_buffer(column)
    if spaces:
        table = np.arange(256, dtype=np.uint8)
        table[list(spaces)] = 32
        buffer = table[buffer]
    n = len(buffer)
    if not n:
        empty = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), empty, empty, np.zeros(len(offsets), np.int64), buffer, offsets)
    inside = ~_SPACE[buffer]
    fresh = np.zeros(n + 1, dtype=bool)
    fresh[offsets] = True
    starts = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1])) | inside & fresh[:n])
    ends = np.flatnonzero(inside & (np.concatenate((~inside[1:], [True])) | fresh[1:])) + 1
    hashes = mix(_ranges(buffer, starts, ends))
    return Words(hashes, starts, ends, np.searchsorted(starts, offsets), buffer, offsets)


def _ranges(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of buffer[start:end] for ascending ranges; prefix sums restart at each stretch of ranges to stay in cache."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(int(np.searchsorted(ends, base + _CHUNK, "right")), at + 1)
        stretch = buffer[base:ends[to - 1]]
        up = powers(_BASE, len(stretch))
        sums = np.zeros(len(stretch) + 1, dtype=np.uint64)
        np.cumsum(_weights[stretch] * up, out=sums[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        down = powers(_INVERSE, len(stretch))
        out[at:to] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        at = to
    return out


def shingles(w: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in text order and the n + 1 bounds of each text; a shorter text is one shingle."""
    counts = np.diff(w.first)
    per = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    bounds = np.concatenate(([0], np.cumsum(per)))
    factors = powers(np.uint64(0xD1342543DE82EF95), size)
    padded = np.concatenate((w.hashes, np.zeros(size, np.uint64)))
    sums = np.zeros(len(w.hashes), dtype=np.uint64)
    for k in range(size):
        sums += padded[k:len(w.hashes) + k] * factors[k]
    text = np.repeat(np.arange(len(counts)), per)
    at = w.first[:-1][text] + np.arange(bounds[-1]) - bounds[:-1][text]
    out = sums[at]
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        h = w.hashes[w.first[i]:w.first[i + 1]]
        out[bounds[i]] = (h * factors[:len(h)]).sum(dtype=np.uint64) + np.uint64(len(h))
    return mix(out), bounds


def distinct_sets(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, and their bounds."""
    out = hashes.copy()
    for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        out[start:end].sort()
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = out[1:] != out[:-1]
    keep[bounds[:-1][np.diff(bounds) > 0]] = True
    return out[keep], np.concatenate(([0], np.cumsum(keep)))[bounds]
