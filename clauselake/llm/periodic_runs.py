"""Periodic run detection by internal pattern matching.

A run is a stretch of words with smallest period q, at least four periods (and
six words) long, that no neighbouring word extends.  For each power of two b,
blocks of b words at every b / 2-nd word are looked up inside their own text: a
suffix array over the words gives all places of a block as one range, and a
wavelet tree over the suffix array gives the first place behind the block's own
(range successor).  Places inside a run form an arithmetic progression, so the
distance is a candidate period; blocks of b words serve the periods in
(b / 2, b].  In a run of period q at least one block starts early enough that it
comes again q words later inside the run, and, being no shorter than q, not
earlier: so no run is missed, and no multiple of a period is taken for it.
Neighbouring blocks with the same distance lie in the same run; its two ends are
less than b / 2 words off and are compared word by word.

All texts of a slice share one suffix array (their words count as different),
which is refined by prefix doubling only where suffixes are still equal.  Work
is one narrow pass over the documents: no shuffle, and memory follows a slice of
about ``SLICE_BYTES`` or the longest single text, whole (some 150 bytes a word).

Cases: a null or empty text has no words and no runs; a null id has no checksum,
so its text is read unchanged; repeated rows give equal results; of a text that is
one word repeated the whole text is one run; extra columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.llm import scan

#: Shortest run in words, and in periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
SLICE_BYTES = 1 << 20
#: Ends that are at most so many words off are compared for all runs at once.
NEAR = 16
SCHEMA = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string")


class WaveletTree:
    """Non-negative integers below ``2**bits``; level by level their bits from
    the highest, zeros before ones, packed with running counts of ones."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.words, self.ones, self.zeros = bits, [], [], []
        n = len(values)
        for level in range(bits - 1, -1, -1):
            one = (values >> level & 1).astype(bool)
            packed = np.packbits(one, bitorder="little")
            word = np.zeros(n // 64 + 1, "<u8")
            word.view(np.uint8)[: len(packed)] = packed
            self.words.append(word)
            self.ones.append(np.concatenate(([0], np.cumsum(np.bitwise_count(word), dtype=np.int64)[:-1])))
            self.zeros.append(n - int(one.sum()))
            values = np.concatenate((values[~one], values[one]))

    def _rank(self, depth: int, at: np.ndarray) -> np.ndarray:
        """Ones before place ``at`` of a level."""
        word = self.words[depth][at >> 6] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.ones[depth][at >> 6] + np.bitwise_count(word)

    def _smaller(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many of the values in places lo..hi-1 are below x."""
        count = np.zeros(len(lo), np.int64)
        for depth in range(self.bits):
            a, b = self._rank(depth, lo), self._rank(depth, hi)
            up = (x >> (self.bits - 1 - depth) & 1).astype(bool)
            count += np.where(up, (hi - lo) - (b - a), 0)
            lo, hi = np.where(up, self.zeros[depth] + a, lo - a), np.where(up, self.zeros[depth] + b, hi - b)
        return count

    def _smallest(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest (from 0) of the values in places lo..hi-1."""
        value = np.zeros(len(lo), np.int64)
        for depth in range(self.bits):
            a, b = self._rank(depth, lo), self._rank(depth, hi)
            zeros = (hi - lo) - (b - a)
            up = k >= zeros
            k = np.where(up, k - zeros, k)
            value = value << 1 | up
            lo, hi = np.where(up, self.zeros[depth] + a, lo - a), np.where(up, self.zeros[depth] + b, hi - b)
        return value

    def successor(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The smallest value of at least x in places lo..hi-1 (-1: none)."""
        out = np.full(len(lo), -1, np.int64)
        k = self._smaller(lo, hi, x)
        some = np.flatnonzero(k < hi - lo)
        out[some] = self._smallest(lo[some], hi[some], k[some])
        return out


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and sizes of the stretches of equal keys."""
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return first, np.diff(first, append=len(keys))


def suffixes(key: np.ndarray, begin: np.ndarray, end: np.ndarray):
    """The suffix array of all texts, the letter of each word, and the blocks to
    look up as rows (length, place, first and last + 1 place of its range).

    ``key`` holds a number a word, different between texts; ``begin`` and
    ``end`` hold the bounds of each word's text."""
    n = len(key)
    order = np.argsort(key)
    first, size = _groups(key[order])
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, size)
    letter = rank.copy()
    live, size = np.flatnonzero(np.repeat(size > 1, size)), np.repeat(size, size)
    size = size[live]
    b, blocks = 1, []
    while len(live):
        at = order[live]
        # a block of a long enough run comes so often in its text
        often = size >= {1: LEAST_WORDS, 2: 3}.get(b, 2)
        near = (at - begin[at]) % max(1, b // 2) == 0
        room = np.maximum(LEAST_PERIODS * (b // 2 + 1), LEAST_WORDS) <= end[at] - begin[at]
        ask = np.flatnonzero(often & near & room)
        blocks.append(np.stack((np.full(len(ask), b), at[ask], rank[at[ask]], rank[at[ask]] + size[ask])))
        behind = at + b
        second = np.where(behind < end[at], rank[np.minimum(behind, n - 1)], -1)
        both = rank[at] * (n + 1) + second + 1
        by = np.argsort(both)
        at = at[by]
        order[live] = at
        first, size = _groups(both[by])
        rank[at] = np.repeat(live[first], size)
        more = np.repeat(size > 1, size)
        live, size = live[more], np.repeat(size, size)[more]
        b *= 2
    return order, letter, np.concatenate(blocks, 1) if blocks else np.zeros((4, 0), np.int64)


def _extended(letter: np.ndarray, lo: np.ndarray, hi: np.ndarray, q: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of period q made as long as they go, by at most ``most`` words at
    each end."""
    code = np.concatenate((letter, [-1]))  # unlike any letter, and unlike what stands q words before it
    lo, hi = lo.copy(), hi.copy()
    few = np.flatnonzero((most > 0) & (most <= NEAR))
    left, right = few, few
    for step in range(NEAR):
        left, right = left[most[left] > step], right[most[right] > step]
        left = left[lo[left] > 0]
        left = left[code[lo[left] - 1] == code[lo[left] - 1 + q[left]]]
        right = right[code[hi[right]] == code[hi[right] - q[right]]]
        lo[left] -= 1
        hi[right] += 1
    for i in np.flatnonzero(most > NEAR).tolist():
        a, z, d, m = int(lo[i]), int(hi[i]), int(q[i]), int(most[i])
        m1 = min(m, a)
        differ = np.flatnonzero(code[a - m1 : a] != code[a - m1 + d : a + d])
        lo[i] = a - m1 + (int(differ[-1]) + 1 if len(differ) else 0)
        m2 = min(m, len(letter) - z)
        differ = np.flatnonzero(code[z : z + m2] != code[z - d : z - d + m2])
        hi[i] = z + (int(differ[0]) if len(differ) else m2)
    return lo, hi


def find_runs(key: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Runs as rows (text, start in the text, length, period), by text, start and
    period; ``first[i]:first[i + 1]`` are the words of text ``i`` in ``key``."""
    size = np.diff(first)
    text = np.repeat(np.arange(len(size)), size)
    if not len(key):
        return np.zeros((0, 4), np.int64)
    begin = first[text]
    order, letter, (b, at, lo, hi) = suffixes(key, begin, first[text + 1])
    tree = WaveletTree(order - begin[order], max(1, int(size.max()).bit_length()))
    q = tree.successor(lo, hi, at - begin[at] + 1) - (at - begin[at])
    good = np.flatnonzero((2 * q > b) & (q <= b))
    good = good[np.lexsort((at[good], q[good], text[at[good]]))]
    b, at, q = b[good], at[good], q[good]
    if not len(at):
        return np.zeros((0, 4), np.int64)
    # neighbours that share their distance are one progression, inside one run
    same = (text[at[1:]] == text[at[:-1]]) & (q[1:] == q[:-1]) & (at[1:] <= at[:-1] + b[:-1])
    chain, length = _groups(np.cumsum(np.concatenate(([True], ~same))))
    b, q, lo, hi = b[chain], q[chain], at[chain], at[chain + length - 1] + q[chain] + b[chain]
    off = np.maximum(1, b // 2) - 1
    least = np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
    long = np.flatnonzero(hi - lo + 2 * off >= least)
    q, least = q[long], least[long]
    lo, hi = _extended(letter, lo[long], hi[long], q, off[long])
    done = np.flatnonzero(hi - lo >= least)
    lo, hi, q = lo[done], hi[done], q[done]
    runs = np.stack((text[lo], lo - begin[lo], hi - lo, q), 1)
    return runs[np.lexsort((q, lo))]


def planted(n: int, crc: int | None) -> tuple[int, int] | None:
    """First word and period of the tail that a checksum divisible by 10 repeats."""
    if crc is None or crc % 10 or n <= 0:
        return None
    g = crc // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _digests(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts, crcs = batch.column("text"), batch.column("crc").to_pylist()
    words = scan.scan(texts)
    first, source = words.first, np.arange(len(words.start))
    for i, crc in enumerate(crcs):
        n = int(first[i + 1] - first[i])
        if tail := planted(n, crc):
            a, p = tail
            source[first[i] + a : first[i + 1]] = first[i] + a + np.arange(n - a) % p
    key = scan.mix(words.hash[source] + words.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    runs = find_runs(key, first)
    cut = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1))
    best: list[list] = [[], [], [], [], []]
    lines, kept = [], []
    for i, text in enumerate(texts):
        own = runs[cut[i] : cut[i + 1], 1:]
        lines.append(hashlib.sha256("".join("%d,%d,%d\n" % tuple(r) for r in own.tolist()).encode()).hexdigest())
        start, length, period = min(own.tolist(), key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        for column, value in zip(best, (len(own), start, length, period, None if length is None else 1000 * length // period)):
            column.append(value)
        items = text.as_buffer().to_pybytes().split() if text.is_valid else []
        if len(own) or (crcs[i] is not None and crcs[i] % 10 == 0):
            keep = np.zeros(len(items) + 1, np.int64)
            np.add.at(keep, own[:, 0] + own[:, 2], 1)
            np.add.at(keep, own[:, 0] + own[:, 1], -1)
            place = (source[first[i] : first[i + 1]] - first[i])[np.cumsum(keep)[:-1] == 0]
            items = [items[j] for j in place.tolist()]
        kept.append(hashlib.sha256(b" ".join(items)).hexdigest())
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in best), pa.array(lines, pa.string()),
                                       pa.array(kept, pa.string())], names=[c.split()[0] for c in SCHEMA.split(", ")])


@scan.lean
def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in scan.slices(batch.column("text"), SLICE_BYTES):
            yield _digests(batch.slice(lo, hi - lo))


def run_digest(documents: DataFrame) -> DataFrame:
    """doc_id, number of runs, the longest one, and digests of all runs and of the
    words that stay, of every document; texts whose id's checksum is divisible by
    10 are read with their planted tail (``planted``)."""
    doc_id = F.col("doc_id").cast("long")
    rows = documents.select(doc_id.alias("doc_id"), F.crc32(doc_id.cast("string").cast("binary")).alias("crc"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_described, SCHEMA)


@scan.lean
def _collapse(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index(text)
        for lo, hi in scan.slices(batch.column(at), SLICE_BYTES):
            part = batch.slice(lo, hi - lo)
            words = scan.scan(part.column(at))
            runs = find_runs(scan.mix(words.hash + words.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), words.first)
            values = part.column(at).to_pylist()
            for i in np.unique(runs[:, 0]).tolist():
                items = values[i].encode().split()
                keep = bytearray(b"\1") * len(items)
                for _, start, length, period in runs[runs[:, 0] == i].tolist():
                    keep[start + period : start + length] = bytes(length - period)
                values[i] = b" ".join(compress(items, keep)).decode()
            yield part.set_column(at, part.schema.field(at), pa.array(values, pa.string()))


def collapse_runs(documents: DataFrame, text: str = "text") -> DataFrame:
    """The input with each run in ``text`` cut to its first period; a text that
    has runs becomes its kept words joined by one space."""
    return documents.mapInArrow(lambda it: _collapse(it, text), documents.schema)
