"""Token counts by rank-synchronous array merging.

Pre-tokens of many texts are held as one ragged array of symbol ids.  In each
round every sequence finds the lowest merge rank among its adjacent pairs and
all sequences apply theirs at once (occurrences of the pair from left to right,
without overlap); a sequence that has no pair left is done, and its surviving
symbols are its tokens.  Only distinct pre-tokens are merged; a bounded cache
keeps counts between slices.  A pre-token of over ``LONG`` bytes keeps its pairs'
ranks, and their places by rank, between rounds: a round then costs as much as
its pair has occurrences.

The vocabulary is a byte-level BPE file of the tokenizers library (its path is
a parameter); special strings found in a text count as one token each, which is
the library's default.  No begin, end or added tokens, no truncation.

Cases: a null or empty text has 0 bytes and 0 tokens; very long texts and
pre-tokens are counted whole (1 MB of letters takes seconds), memory follows a
slice of about ``SLICE_BYTES`` or the longest text; extra columns are not read; repeated rows are counted each; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.llm import scan

#: Fixed value: the split of byte-level BPE into pre-tokens.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE = 250_000
SLICE_BYTES = 4 << 20
#: UTF-8 bytes of pre-tokens merged at a time.
MERGE_BYTES = 2 << 20
_NONE = np.int64(1 << 40)
#: Bytes from which a pre-token keeps its ranks between rounds.
LONG = 2048


def byte_symbols() -> dict[str, int]:
    """The characters that stand for the 256 bytes in byte-level vocabularies:
    printable Latin-1 ones for themselves, the rest from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class RankMerger:
    """Merge tables of one vocabulary as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.base = np.zeros(256, np.int64)
        for char, byte in byte_symbols().items():
            self.base[byte] = vocab[char]
        self.size = max(vocab.values()) + 1
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        """Number of tokens of each pre-token."""
        out = np.zeros(len(tokens), np.int64)
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        if (long := np.flatnonzero(sizes > LONG)).size:
            out[long] = [self._long(tokens[i]) for i in long.tolist()]
            rest = np.flatnonzero(sizes <= LONG)
            out[rest] = self.counts([tokens[i] for i in rest.tolist()])
            return out
        total = np.concatenate(([0], np.cumsum(sizes)))
        lo = 0
        while lo < len(tokens):
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + MERGE_BYTES, "right")) - 1)
            out[lo:hi] = self._merge(b"".join(tokens[lo:hi]), sizes[lo:hi])
            lo = hi
        return out

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.ranks[at], _NONE)

    def _long(self, token: bytes) -> int:
        """Number of tokens of one long pre-token."""
        sym = self.base[np.frombuffer(token, np.uint8)]
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.full(n, _NONE)  # of each symbol with the one after it
        rank[:-1] = self._rank(sym[:-1], sym[1:])
        places: dict[int, list[np.ndarray]] = {}

        def file(at: np.ndarray) -> list[int]:
            """Puts places down under their ranks; returns ranks that are new."""
            at = at[rank[at] != _NONE]
            at = at[np.argsort(rank[at], kind="stable")]
            cut = np.flatnonzero(np.diff(rank[at])) + 1
            fresh = []
            for part in np.split(at, cut) if len(at) else ():
                r = int(rank[part[0]])
                if r not in places:
                    places[r] = []
                    fresh.append(r)
                places[r].append(part)
            return fresh

        left, heap = n, file(np.arange(n))
        heapify(heap)
        while heap:
            r = heappop(heap)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            # of touching occurrences (one symbol paired with itself) every second stays
            begin = np.concatenate(([True], at[1:] != after[at[:-1]]))
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(begin, place, 0))) % 2 == 0]
            gone = after[at]
            sym[at], rank[gone] = self.made[r], _NONE
            after[at] = ahead = after[gone]
            inside = ahead < n
            before[ahead[inside]] = at[inside]
            left -= len(at)
            changed = np.unique(np.concatenate((at, before[at][before[at] >= 0])))
            paired = changed[after[changed] < n]
            rank[changed] = _NONE
            rank[paired] = self._rank(sym[paired], sym[after[paired]])
            for new in file(paired):
                heappush(heap, new)
        return left

    def _merge(self, data: bytes, sizes: np.ndarray) -> np.ndarray:
        left = np.zeros(len(sizes), np.int64)
        sym = self.base[np.frombuffer(data, np.uint8)]
        seq = np.repeat(np.arange(len(sizes)), sizes)
        while len(sym):
            pair = sym[:-1] * self.size + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.full(len(sym), _NONE)
            real = (self.keys[at] == pair) & (seq[:-1] == seq[1:])
            rank[:-1][real] = self.ranks[at[real]]
            head = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            length = np.diff(np.concatenate((head, [len(sym)])))
            low = np.repeat(np.minimum.reduceat(rank, head), length)
            done = low == _NONE
            if done.any():
                left += np.bincount(seq[done], minlength=len(left))
            hit = (rank == low) & ~done
            # of touching occurrences (one symbol paired with itself) every second stays
            place = np.arange(len(sym))
            begin = hit & ~np.concatenate(([False], hit[:-1]))
            begin[head] = hit[head]
            run = np.maximum.accumulate(np.where(begin, place, -1))
            hit &= (place - run) % 2 == 0
            sym[hit] = self.made[low[hit]]
            keep = ~done
            keep[1:] &= ~hit[:-1]
            sym, seq = sym[keep], seq[keep]
        return left


class TextCounter:
    """Token counts of texts, with a bounded cache of pre-token counts."""

    def __init__(self, path: str):
        self.merger = RankMerger(path)
        self.split = regex.compile(SPLIT)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.merger.special, key=len, reverse=True))) or r"(?!)")
        self.cache: dict[str, int] = {}

    def __call__(self, texts: list[str]) -> list[int]:
        cut = []
        for text in texts:
            parts = self.special.split(text)
            cut.append((len(parts) - 1, [t for p in parts for t in self.split.findall(p)]))
        new = list({t for _, tokens in cut for t in tokens} - self.cache.keys())
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = list({t for _, tokens in cut for t in tokens})
        self.cache.update(zip(new, self.merger.counts([t.encode() for t in new]).tolist()))
        return [n + sum(map(self.cache.__getitem__, tokens)) for n, tokens in cut]


@scan.lean
def _count(batches: Iterator[pa.RecordBatch], path: str, limit: int) -> Iterator[pa.RecordBatch]:
    counter = TextCounter(path)
    for batch in batches:
        for lo, hi in scan.slices(batch.column("text"), SLICE_BYTES):
            part = batch.slice(lo, hi - lo)
            texts = [t or "" for t in part.column("text").to_pylist()]
            n = pa.array(counter(texts), pa.int64())
            size = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, n, pa.array([x.as_py() > limit for x in n], pa.bool_())],
                                             names=["doc_id", "n_bytes", "n_tokens", "over_limit"])


def count_tokens(documents: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document.  ``path`` is
    the vocabulary file, the same on every executor."""
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        lambda it: _count(it, path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
