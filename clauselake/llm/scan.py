"""Word scanning of Arrow text batches with numpy.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; those bytes are
ASCII, so scanning the UTF-8 bytes gives the same words as scanning code
points.  A null text has no words.  All functions work on one bounded slice of
a batch at a time, so memory follows the slice (or the longest single text),
never the partition.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Odd 64-bit multipliers of the hashes below.
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_LANE = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
#: Words above this many bytes are hashed one by one.
_LONG_WORD = 256


def give_back() -> None:
    """Hand freed memory back to the system: Spark keeps Python workers for
    later stages, which share an executor's limit with them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


def lean(batches_in_out):
    """A function over a partition's batches that ends with ``give_back``."""

    @functools.wraps(batches_in_out)
    def run(*args):
        try:
            yield from batches_in_out(*args)
        finally:
            give_back()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (every output bit depends on every input bit)."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of several texts: bytes, word bounds, text number and 64-bit hash
    of each word; ``first[i]:first[i + 1]`` are the words of text ``i``."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def body(self) -> np.ndarray:
        """Bytes of all words without what lies between them."""
        raw = self.buf[: len(self.buf) - 8]
        return raw[~SPACE[raw]]


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated UTF-8 bytes of the texts and their n + 1 offsets."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = pc.fill_null(texts, b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def scan(texts: pa.Array, lower: bool = False, hashes: bool = True) -> Words:
    """Words of all texts; ``lower`` folds A-Z first."""
    raw, at = as_bytes(texts)
    buf = np.zeros(len(raw) + 8, np.uint8)
    buf[: len(raw)] = raw
    if lower:
        up = (buf >= 65) & (buf <= 90)
        buf[up] |= 32
    inside = ~SPACE[buf[: len(raw)]]
    edge = np.zeros(len(raw) + 1, bool)  # a text begins here, or all end
    edge[at] = True
    before = np.concatenate(([False], inside[:-1])) if len(inside) else inside
    after = np.concatenate((inside[1:], [False])) if len(inside) else inside
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(start, at)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    return Words(buf, start, end, doc, first, word_hashes(buf, start, end) if hashes else np.zeros(0, np.uint64))


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte run; ``buf`` has 8 spare bytes at its end."""
    size = end - start
    out = mix(size.astype(np.uint64) * _M1 + _M1)
    if not len(start):
        return out
    lanes = np.ndarray((len(buf) - 7,), "<u8", buffer=buf.data, strides=(1,))
    live = np.arange(len(start))
    k = 0
    while len(live := live[size[live] > k]) and k < _LONG_WORD:
        left = np.minimum(size[live] - k, 8)
        out[live] = mix((out[live] ^ (lanes[start[live] + k] & _LANE[left])) * _M1)
        k += 8
    for i in np.flatnonzero(size > _LONG_WORD):
        digest = hashlib.blake2b(buf[start[i] : end[i]].tobytes(), digest_size=8).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def windows(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of ``k`` consecutive word hashes (len(h) - k + 1)."""
    n = max(0, len(h) - k + 1)
    out = np.full(n, salt + k, np.uint64)
    for j in range(k):  # not linear in the words, so no rearrangement cancels out
        out += h[j : j + n]
        out *= _M2
        out ^= out >> np.uint64(29)
    return mix(out)


def slices(texts: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes (a longer text is
    alone in its range)."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate(([0], np.cumsum(sizes)))
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + limit, "right")) - 1)
        yield lo, min(hi, len(sizes))
        lo = hi
