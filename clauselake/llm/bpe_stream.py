"""BPE encoding and decoding as streaming transducers.

Encoding.  Let a word's symbols arrive from the left.  What is still to come
can undo a token only through merges that reach back to it.  Each such step
moves the edge of what may still change to the left by one token ``a`` of a
merge ``(a, b)`` whose ``b`` begins at the edge, so ``b`` begins with the
``a`` of the step before; and a later step has a later merge, as what it joins
had to be made first.  The longest total length of such a chain of merges,
computed once from the merge list, is the lookahead: a token that ends at least
so many symbols before the end of what has arrived is stable and is emitted.
Between the last stable token and the end lie a bounded number of symbols, which
is all that the transducer holds.  ``Encoder`` feeds it the symbols of every word,
``BLOCK`` at a time, and hands on what is stable; a word that ends before anything
has to be settled is merged when it ends.  Ids of words up to ``BLOCK`` characters
are kept in a bounded cache; a longer word's are handed on block by block.  Held
beside them is a piece of text up to the next white space.

Decoding.  Ids become bytes, and an incremental UTF-8 state machine turns bytes
into text while a character may still be cut between two tokens.

The vocabulary is a word-end BPE file of the tokenizers library (its path is a
parameter) that normalises by NFC, one space for white space, and lower case.
Special strings in a text are one token each, the library's default.

Cases: a null or empty text has no tokens and decodes to nothing; extra columns
are not read; repeated rows give equal results; very long texts and words are
coded whole; an empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.llm import scan
from clauselake.llm.token_counts import byte_symbols

#: Fixed value: the split of this kind of vocabulary into pre-tokens.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"""
WORD_END = "</w>"
#: Symbols taken in between two emissions of a long word.
BLOCK = 1024
#: Characters of a text normalised and split at a time (cut at white space).
PIECE = 1 << 16
CACHE = 400_000
#: Sequences up to this length are merged by scanning.
_SHORT, _NONE = 48, 1 << 40
#: Ids decoded at a time.
IDS = 1 << 15


class Vocabulary:
    """Symbols, merges and the sufficient lookahead of one vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ids: dict[str, int] = dict(spec["model"]["vocab"])
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ranks = {m: i for i, m in enumerate(merges)}
        self.lookahead = lookahead(merges)
        names = {i: s for s, i in (self.ids | self.special).items()}
        self.pieces = [names.get(i, "").encode() for i in range(max(names) + 1)]
        self.chars = {b: c for c, b in byte_symbols().items()}


def symbols(token: str) -> tuple[str, ...]:
    """A token's base symbols; the word end belongs to the last."""
    if token.endswith(WORD_END) and len(token) > len(WORD_END):
        body = token[: -len(WORD_END)]
        return (*body[:-1], body[-1] + WORD_END)
    return tuple(token)


def lookahead(merges: list[tuple[str, str]]) -> int:
    """Symbols after a token's end that settle it (see the module's text)."""
    reach: dict[tuple[str, ...], int] = {}  # by left part: length of the longest chain that ends with it
    longest = 0
    for a, b in merges:
        left, right = symbols(a), symbols(b)
        before = max((reach.get(right[:n], 0) for n in range(1, len(right) + 1)), default=0)
        here = len(left) + before
        reach[left] = max(reach.get(left, 0), here)
        longest = max(longest, here)
    return longest + 1


def merge(parts: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Tokens of a whole symbol sequence: lowest rank first, from the left."""
    if len(parts) > _SHORT:
        return _merge_long(parts, ranks)
    parts = list(parts)
    of = ranks.get
    found = [of(p, _NONE) for p in zip(parts, parts[1:])]
    while found and (low := min(found)) != _NONE:
        i = found.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del found[i]
        if i:
            found[i - 1] = of((parts[i - 1], parts[i]), _NONE)
        if i < len(found):
            found[i] = of((parts[i], parts[i + 1]), _NONE)
    return parts


def _merge_long(parts: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """The same with a heap, for sequences where scanning for the lowest rank
    would take longest."""
    n = len(parts)
    parts = list(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if parts[i] != a or j >= n or parts[j] != b:
            continue  # one of the two has been merged meanwhile
        parts[i], parts[j] = a + b, ""
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get((parts[i], parts[k]))) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[k]))
        if (h := before[i]) >= 0 and (r := ranks.get((parts[h], parts[i]))) is not None:
            heapq.heappush(heap, (r, h, parts[h], parts[i]))
    return [p for p in parts if p]


class WordTransducer:
    """Tokens of one word whose symbols arrive bit by bit."""

    def __init__(self, ranks: dict[tuple[str, str], int], ahead: int):
        self.ranks, self.ahead, self.held = ranks, ahead, []

    def feed(self, parts: list[str]) -> list[str]:
        """Tokens that are stable now."""
        self.held += parts
        out: list[str] = []
        if len(self.held) <= self.ahead + 1:
            return out  # nothing can be stable yet
        # the last symbol may yet turn out to end the word
        known = self.held[:-1]
        at, stable = 0, len(known) - self.ahead
        for token in merge(known, self.ranks):
            if at + len(token) > stable:
                break
            out.append(token)
            at += len(token)
        del self.held[:at]
        return out

    def finish(self) -> list[str]:
        held, self.held = self.held, []
        if held:
            held[-1] += WORD_END
            held = merge(held, self.ranks)
        return held


class Encoder:
    """Ids of texts, packed as little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary, block: int = BLOCK):
        self.v, self.block = vocabulary, block
        self.split = regex.compile(SPLIT)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")"
                                     if vocabulary.special else r"((?!))")
        self.space = regex.compile(r"\s+")
        self.cache: dict[str, bytes] = {}
        self.machine = WordTransducer(vocabulary.ranks, vocabulary.lookahead)

    def stream(self, word: str) -> Iterator[bytes]:
        """Ids of one pre-token, as they settle."""
        plain = word.isascii() and word.isalnum()
        for i in range(0, len(word), self.block):
            part = word[i : i + self.block]
            if settled := self.machine.feed(list(part if plain else map(self.v.chars.__getitem__, part.encode()))):
                yield self._packed(settled)
        yield self._packed(self.machine.finish())

    def _packed(self, tokens: list[str]) -> bytes:
        return struct.pack(f"<{len(tokens)}I", *map(self.v.ids.__getitem__, tokens))

    def word(self, word: str) -> bytes:
        """All ids of a pre-token of one block."""
        machine = self.machine
        tokens = machine.feed(list(word if word.isascii() and word.isalnum() else map(self.v.chars.__getitem__, word.encode())))
        tokens += machine.finish()
        return struct.pack(f"<{len(tokens)}I", *map(self.v.ids.__getitem__, tokens))

    def normal(self, text: str) -> str:
        # lower-casing goes character by character, so no final sigma
        return self.space.sub(" ", unicodedata.normalize("NFC", text)).replace("Σ", "σ").lower()

    def pieces(self, text: str) -> Iterator[str]:
        """Parts of about ``PIECE`` characters that begin with white space."""
        at = 0
        while at < len(text):
            cut = self.space.search(text, at + PIECE)
            end = cut.start() if cut else len(text)
            yield text[at:end]
            at = end

    def __call__(self, text: str) -> Iterator[bytes]:
        """The ids of a text, part by part."""
        cache = self.cache
        for part in self.special.split(text):
            if part in self.v.special:
                yield struct.pack("<I", self.v.special[part])
                continue
            for piece in self.pieces(part):
                words = self.split.findall(self.normal(piece))
                if len(cache) > CACHE:
                    cache.clear()
                long = False
                for w in set(words):
                    if w not in cache:
                        if len(w) > self.block:
                            long = True
                        else:
                            cache[w] = self.word(w)
                if not long:
                    yield b"".join(map(cache.__getitem__, words))
                    continue
                for w in words:
                    if len(w) > self.block:
                        yield from self.stream(w)
                    else:
                        yield cache[w]


class Decoder:
    """Text of ids that arrive bit by bit.

    ``raw``: vocabulary strings joined by one space, as the library decodes a
    file without a decoder.  Otherwise the text itself: byte characters become
    bytes and a word end becomes a space."""

    def __init__(self, vocabulary: Vocabulary, raw: bool = True):
        self.raw, self.begun = raw, False
        self.table = vocabulary.pieces if raw else [self._bytes(p.decode(), vocabulary) for p in vocabulary.pieces]
        self.state = codecs.getincrementaldecoder("utf-8")(errors="replace")

    @staticmethod
    def _bytes(piece: str, vocabulary: Vocabulary) -> bytes:
        if piece in vocabulary.special:
            return piece.encode()
        end = piece.endswith(WORD_END)
        of = byte_symbols()
        return bytes(of[c] for c in (piece[: -len(WORD_END)] if end else piece)) + b" " * end

    def feed(self, ids: list[int]) -> str:
        if not ids:
            return ""
        data = (b" " if self.raw else b"").join(map(self.table.__getitem__, ids))
        if self.raw and self.begun:
            data = b" " + data
        self.begun = True
        return self.state.decode(data)

    def finish(self) -> str:
        return self.state.decode(b"", True)


@scan.lean
def _digests(batches: Iterator[pa.RecordBatch], path: str, keep: bool) -> Iterator[pa.RecordBatch]:
    vocabulary = Vocabulary(path)
    encode = Encoder(vocabulary)
    for batch in batches:
        rows, whole = [], []
        for value in batch.column("text"):
            coded, text, n = hashlib.sha256(), hashlib.sha256(), 0
            back = Decoder(vocabulary)
            parts = []
            for part in encode(value.as_py() or ""):
                coded.update(part)
                if keep:
                    parts.append(part)
                ids = np.frombuffer(part, "<u4")
                n += len(ids)
                for i in range(0, len(ids), IDS):
                    text.update(back.feed(ids[i : i + IDS].tolist()).encode())
            text.update(back.finish().encode())
            rows.append((n, coded.hexdigest(), text.hexdigest()))
            whole.append(b"".join(parts))
        n, coded, text = zip(*rows) if rows else ((), (), ())
        out = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(text, pa.string()), pa.array(whole, pa.binary())]
        yield pa.RecordBatch.from_arrays(out[: 4 + keep], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + keep])


def code_digests(documents: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, and with
    ``ids`` its ids as little-endian unsigned 32-bit integers."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if ids else "")
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _digests(it, path, ids), schema)


def _ids(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encode = Encoder(Vocabulary(path))
    for batch in batches:
        coded = [None if t is None else np.frombuffer(b"".join(encode(t)), "<u4").astype(np.int32).tolist() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(coded, pa.list_(pa.int32()))], names=["doc_id", "ids"])


def encode(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (null for a null text)."""
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _ids(it, path), "doc_id long, ids array<int>")


def _texts(batches: Iterator[pa.RecordBatch], path: str, raw: bool) -> Iterator[pa.RecordBatch]:
    vocabulary = Vocabulary(path)
    for batch in batches:
        out = []
        for ids in batch.column("ids").to_pylist():
            back = Decoder(vocabulary, raw)
            out.append(None if ids is None else "".join(back.feed(ids[i : i + IDS]) for i in range(0, len(ids), IDS)) + back.finish())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])


def decode(coded: DataFrame, path: str, raw: bool = True) -> DataFrame:
    """doc_id, text of encoded documents."""
    return coded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(
        lambda it: _texts(it, path, raw), "doc_id long, text string")
