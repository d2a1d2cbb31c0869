"""Substring dedup by super-k-mer partitioning.

A window is ``k`` consecutive words of one document.  A word goes if a window
that covers it has the same word sequence as a window of a document with a
smaller ``doc_id``.

1. Each window's minimiser is the smallest hash among its ``m``-word runs.
   Consecutive windows with the same minimiser travel as one packed string (the
   words joined by one space) to the bucket of that minimiser, so equal windows
   meet in one bucket wherever they occur.  Where one minimiser's strings would
   take ``HOT_BYTES`` or more (a frequent phrase in ever new surroundings), its
   windows travel one by one to the bucket of their own hash, so a bucket is
   bounded and equal windows still meet.
2. Before the shuffle, equal packed strings of a slice of documents are folded
   to the smallest document that has them: in every other one all their windows
   are repeats already, and only their spans are passed on.  A passage or copy
   that a third of all rows share so sends one string for each slice.
3. In a bucket, sorting the windows brings equal ones together; each group's
   words are compared exactly, and windows of all but the smallest document
   give the spans to remove.
4. Spans are gathered by document and applied to the input's words.

Cases: a null or empty text has no words and none to remove; fewer words than
``k`` make no window; rows that repeat a ``doc_id`` are one document (none is
smaller) but keep their own spans by text; a null ``doc_id`` counts as the
largest; an empty table gives an empty result.  Only the two named columns are
read; extra ones pass through ``remove_repeats`` untouched, and their names may
clash with nothing (working columns carry the prefix ``_sd_``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from clauselake.llm import scan

WINDOW = 13
#: Words in the runs whose smallest hash is a window's minimiser.
MINIMISER = 5
#: Packed bytes that a bucket should hold; buckets are worked on one at a time.
BUCKET_BYTES = 16 << 20
#: Packed bytes from which on the windows of a minimiser are dealt by their own hash.
HOT_BYTES = BUCKET_BYTES
#: A bucket is worked on in so many parts (by further bits of the minimiser).
PARTS = 4
#: Bytes of text that are cut and folded at a time.
SLICE_BYTES = 4 << 20
#: Super-k-mers take about this many bytes for a byte of text at 13 and 5 words.
EXPANSION = 4
_LAST = 2**63 - 1


def _pack(ids, keys, starts, parts, strings) -> bytes:
    """Columns of packed strings as one compressed blob."""
    lens = np.fromiter(map(len, strings), np.int32, len(strings))
    steps = np.diff(np.asarray(ids, np.int64), prepend=np.int64(0))
    # byte planes: the high bytes of small numbers are all zero and vanish
    planes = (np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes()
              for c in (steps, np.asarray(keys, np.int32), np.asarray(starts, np.int32), np.asarray(parts, np.int8), lens))
    return zstandard.ZstdCompressor(level=3).compress(b"".join((np.int64(len(strings)).tobytes(), *planes, *strings)))


def _unpack(blob: bytes):
    body = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(body, np.int64, 1)[0])
    at, out = 8, []
    for kind in (np.int64, np.int32, np.int32, np.int8, np.int32):
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(body, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += n * size
    return (np.cumsum(out[0]), *out[1:], np.frombuffer(body, np.uint8, len(body) - at, at))


def _merge(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans sorted by start."""
    reach = np.maximum.accumulate(end)
    new = np.concatenate(([True], start[1:] > reach[:-1]))
    at = np.flatnonzero(new)
    return start[at], reach[np.concatenate((at[1:], [len(start)])) - 1]


def _span_rows(ids, keys, start, end):
    """(doc_id, key, spans) of spans in any order, united by document."""
    if not len(ids):
        return
    order = np.lexsort((start, keys, ids))
    ids, keys, start, end = ids[order], keys[order], start[order], end[order]
    cut = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]))))
    for lo, hi in zip(cut, [*cut[1:], len(ids)]):
        a, b = _merge(start[lo:hi], end[lo:hi])
        yield int(ids[lo]), int(keys[lo]), np.stack((a, b), 1).astype(np.int32).ravel().tolist()


def super_kmers(words: scan.Words, k: int, m: int):
    """(text number, first word, last word + 1, minimiser) of each run of
    windows with one minimiser."""
    n = len(words.hash) - k + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    grams = scan.windows(words.hash, m)
    low, width = grams, 1  # sliding minimum over k - m + 1 runs
    while width < k - m + 1:
        step = min(width, k - m + 1 - width)
        low = np.minimum(low[: len(low) - step], low[step:])
        width += step
    fits = words.doc[:n] == words.doc[k - 1 :]
    head = fits.copy()
    head[1:] &= ~fits[:-1] | (low[1:] != low[:-1]) | (words.doc[1:n] != words.doc[: n - 1])
    first = np.flatnonzero(head)
    stop = fits.copy()
    stop[:-1] &= ~fits[1:] | head[1:]
    return words.doc[first], first, np.flatnonzero(stop) + k, low[first]


@scan.lean
def _weigh(batches: Iterator[pa.RecordBatch], k: int, m: int, share: float) -> Iterator[pa.RecordBatch]:
    """Packed bytes of the minimisers that have half of ``share`` of a slice's.
    What they have elsewhere is at most half of ``share`` of all."""
    for batch in batches:
        for lo, hi in scan.slices(batch.column("_sd_text"), SLICE_BYTES):
            words = scan.scan(batch.column("_sd_text").slice(lo, hi - lo))
            _, first, stop, low = super_kmers(words, k, m)
            if not len(low):
                continue
            at = np.concatenate(([0], np.cumsum(words.end - words.start + 1)))
            order = np.argsort(low, kind="stable")
            low, size = low[order], (at[stop] - at[first])[order]
            head = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
            total = np.add.reduceat(size, head)
            much = 2 * total >= share * total.sum()
            yield pa.RecordBatch.from_arrays([pa.array(low[head][much].view(np.int64)), pa.array(total[much].astype(np.int64))], names=["low", "n"])


def hot_minimisers(texts: DataFrame, size: int, k: int = WINDOW, m: int = MINIMISER) -> np.ndarray:
    """All minimisers with ``HOT_BYTES`` packed bytes or more (and some with half
    of that) in texts of ``size`` bytes, sorted; two for each ``HOT_BYTES`` at most."""
    whole = size * EXPANSION
    if whole < HOT_BYTES:
        return np.zeros(0, np.uint64)
    share = HOT_BYTES / whole
    found = texts.select("_sd_text").mapInArrow(lambda it: _weigh(it, k, m, share), "low long, n long").groupBy("low").agg(F.sum("n").alias("n"))
    return np.sort(found.filter(2 * F.col("n") >= HOT_BYTES).select("low").toArrow().column(0).to_numpy().view(np.uint64))


def _single(words: scan.Words, k: int, doc, first, stop, low, hot: np.ndarray):
    """The runs, those of hot minimisers cut into windows with their own hash."""
    if not len(hot):
        return doc, first, stop, low
    at = np.minimum(np.searchsorted(hot, low), len(hot) - 1)
    n = np.where(hot[at] == low, stop - first - k + 1, 1)
    alone = np.repeat(hot[at] == low, n)
    doc, low, end, begin = (np.repeat(c, n) for c in (doc, low, stop, first))
    first = begin + np.where(alone, np.arange(len(begin)) - np.repeat(np.cumsum(n) - n, n), 0)
    whole = scan.windows(words.hash, k)
    return doc, first, np.where(alone, first + k, end), np.where(alone, whole[np.minimum(first, len(whole) - 1)], low)


@scan.lean
def _cut(batches: Iterator[pa.RecordBatch], buckets: int, k: int, m: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blobs of packed strings by bucket, and spans known from the slice alone."""
    for batch in batches:
        for lo, hi in scan.slices(batch.column("_sd_text"), SLICE_BYTES):
            part = batch.slice(lo, hi - lo)
            ids = part.column("_sd_id").to_numpy()
            keys = part.column("_sd_key").to_numpy()
            words = scan.scan(part.column("_sd_text"))
            doc, first, stop, low = _single(words, k, *super_kmers(words, k, m), hot)
            if not len(doc):
                continue
            # one space for each run of white space, so equal windows are equal bytes
            body, size = words.body(), words.end - words.start
            at = np.cumsum(size + 1) - (size + 1)
            flat = np.full(len(body) + len(size), 32, np.uint8)
            letters = np.ones(len(flat), bool)
            letters[at + size] = False
            flat[letters] = body
            text = flat.tobytes()
            owner, least, seen = ids[doc], {}, []
            begin, finish = at[first].tolist(), (at[stop - 1] + size[stop - 1]).tolist()
            for a, b, d in zip(begin, finish, owner.tolist()):
                seen.append(s := text[a:b])
                if least.get(s, _LAST + 1) > d:
                    least[s] = d
            ship = np.fromiter(map(int.__eq__, map(least.__getitem__, seen), owner.tolist()), bool, len(seen))
            local = first - words.first[doc]
            again = ~ship
            order = np.flatnonzero(ship)
            if len(order):
                bucket = (low % np.uint64(buckets)).astype(np.int64)
                share = (low // np.uint64(buckets) % np.uint64(PARTS)).astype(np.int8)
                order = order[np.argsort(bucket[order], kind="stable")]
                cut = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) != 0)))
                made = []
                for x, y in zip(cut, [*cut[1:], len(order)]):
                    pick = order[x:y]
                    made.append(_pack(ids[doc[pick]], keys[doc[pick]], local[pick], share[pick], [seen[i] for i in pick.tolist()]))
                n = len(made)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[order[cut]]), pa.array(made, pa.large_binary()).cast(pa.binary()),
                     pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int32()))],
                    names=["bucket", "blob", "id", "key", "spans"])
            if again.any():
                rows = list(_span_rows(owner[again], keys[doc[again]], local[again], local[again] + (stop - first)[again]))
                to = np.array([r[0] for r in rows], np.int64) % buckets
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to), pa.nulls(len(rows), pa.binary()), pa.array([r[0] for r in rows], pa.int64()),
                     pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.int32()))],
                    names=["bucket", "blob", "id", "key", "spans"])


def _repeats(ids, lens, data, k):
    """Of a bucket's packed strings: string number and first word (within the
    string) of each window that a smaller document has as well."""
    edges = np.concatenate(([0], np.cumsum(lens, dtype=np.int64)))
    words = scan.scan(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))]))
    n = len(words.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(words.doc[:n] == words.doc[k - 1 :])
    h = scan.windows(words.hash, k)[at]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    keep = np.zeros(len(order), bool)  # windows with an equal hash elsewhere
    keep[1:] |= same
    keep[:-1] |= same
    order = order[keep]
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = _codes(words)
    at = at[order]
    new = np.concatenate(([True], h[order][1:] != h[order][:-1]))
    lead = at[np.flatnonzero(new)][np.cumsum(new) - 1]
    if any((codes[at + j] != codes[lead + j]).any() for j in range(k)):
        # different windows with one hash: group by the words themselves
        full = np.stack([codes[at + j] for j in range(k)])
        order = np.lexsort(full[::-1])
        at, full = at[order], full[:, order]
        new = np.concatenate(([True], (full[:, 1:] != full[:, :-1]).any(0)))
    group = np.cumsum(new) - 1
    owner = ids[words.doc[at]]
    least = np.minimum.reduceat(owner, np.flatnonzero(new))
    at = at[owner > least[group]]
    return words.doc[at], at - words.first[words.doc[at]]


def _codes(words: scan.Words) -> np.ndarray:
    """A number for each word, equal for equal words only."""
    size, body = words.end - words.start, words.body()
    edges = np.concatenate(([0], np.cumsum(size)))
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(edges), pa.py_buffer(body)])
    return array.dictionary_encode().indices.to_numpy()


def _bucket_spans(table: pa.Table, k: int) -> pa.Table:
    """Spans to remove, from one bucket."""
    ids, keys, spans = (table.column(c) for c in ("id", "key", "spans"))
    known = ids.is_valid()
    out = [(i, t, s) for i, t, s in zip(*(c.filter(known).to_pylist() for c in (ids, keys, spans)))]
    blobs = [_unpack(b.as_py()) for b in table.column("blob") if b.is_valid]
    if blobs:
        columns = [np.concatenate(x) for x in zip(*blobs)]
        del blobs
        share, lens = columns[3:5]
        for n in range(PARTS):
            own = share == n
            ids, keys, starts = (c[own] for c in columns[:3])
            string, word = _repeats(ids, lens[own], columns[5][np.repeat(own, lens)], k)
            start = starts[string] + word
            out += _span_rows(ids[string], keys[string], start, start + k)
    scan.give_back()
    return pa.table({"id": pa.array([r[0] for r in out], pa.int64()), "key": pa.array([r[1] for r in out], pa.int32()),
                     "spans": pa.array([r[2] for r in out], pa.list_(pa.int32()))})


def _keyed(documents: DataFrame, text: str, doc_id: str) -> DataFrame:
    """The input with its row key: the id, null last, and a hash of the text."""
    return documents.withColumns({"_sd_id": F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(_LAST)),
                                  "_sd_key": F.hash(F.col(f"`{text}`"))})


def repeated_spans(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = WINDOW,
                   m: int = MINIMISER) -> DataFrame:
    """``_sd_id, _sd_key, _sd_spans``: for each document with repeats, arrays of
    alternating first words and ends of spans to remove."""
    spark = documents.sparkSession
    rows = _keyed(documents, text, doc_id).select("_sd_id", "_sd_key", F.col(f"`{text}`").alias("_sd_text"))
    size = documents.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size * EXPANSION // BUCKET_BYTES))
    hot = hot_minimisers(rows, size, k, m)
    cut = rows.mapInArrow(lambda it: _cut(it, buckets, k, m, hot), "bucket long, blob binary, id long, key int, spans array<int>")
    found = cut.groupBy("bucket").applyInArrow(lambda t: _bucket_spans(t, k), "id long, key int, spans array<int>")
    return found.groupBy(F.col("id").alias("_sd_id"), F.col("key").alias("_sd_key")).agg(
        F.flatten(F.collect_list("spans")).alias("_sd_spans"))


@scan.lean
def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text column ``_sd_text`` compressed, for the shuffle."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        at = batch.schema.get_field_index("_sd_text")
        packed = [None if t is None else press.compress(t.encode()) for t in batch.column(at).to_pylist()]
        yield batch.set_column(at, "_sd_text", pa.array(packed, pa.binary()))


def _marked(documents: DataFrame, text: str, doc_id: str, k: int, m: int, keep: list[str]) -> DataFrame:
    """The columns ``keep`` beside the compressed text and its spans."""
    rows = _keyed(documents, text, doc_id).select(*(F.col(f"`{c}`") for c in keep), "_sd_id", "_sd_key", F.col(f"`{text}`").alias("_sd_text"))
    packed = StructType([StructField("_sd_text", BinaryType()) if f.name == "_sd_text" else f for f in rows.schema])
    return rows.mapInArrow(_squeeze, packed).join(repeated_spans(documents, text, doc_id, k, m), ["_sd_id", "_sd_key"], "left")


def _text(packed: pa.Scalar) -> str | None:
    return zstandard.ZstdDecompressor().decompress(packed.as_py()).decode() if packed.is_valid else None


def _kept(text: str | None, spans: list[int] | None) -> tuple[int, list[bytes]]:
    """Number of words, and the words that stay."""
    words = (text or "").encode().split()
    if not spans:
        return len(words), words
    keep = bytearray(b"\1") * len(words)
    for a, b in zip(spans[::2], spans[1::2]):
        keep[a:b] = bytes(b - a)
    return len(words), list(compress(words, keep))


@scan.lean
def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("_sd_text"), batch.column("_sd_spans")):
            n, words = _kept(_text(text), spans.as_py())
            rows.append((n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
        n, gone, digest = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                                          pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def dedup_digest(documents: DataFrame, k: int = WINDOW, m: int = MINIMISER) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    marked = _marked(documents, "text", "doc_id", k, m, ["doc_id"])
    return marked.select(F.col("doc_id").cast("long"), "_sd_text", "_sd_spans").mapInArrow(
        _digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


@scan.lean
def _rewrite(batches: Iterator[pa.RecordBatch], text: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for value, spans in zip(batch.column("_sd_text"), batch.column("_sd_spans")):
            value, spans = _text(value), spans.as_py()
            out.append(b" ".join(_kept(value, spans)[1]).decode() if spans else value)
        new = pa.array(out, pa.string())
        yield pa.RecordBatch.from_arrays([new if c == text else batch.column(c) for c in columns], names=columns)


def remove_repeats(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = WINDOW,
                   m: int = MINIMISER) -> DataFrame:
    """The input with repeated words taken out of ``text``; a text that loses
    none stays as it is, any other becomes its kept words joined by one space."""
    columns = documents.columns
    marked = _marked(documents, text, doc_id, k, m, [c for c in columns if c != text])
    return marked.mapInArrow(lambda it: _rewrite(it, text, columns), documents.schema)


#: The same digest in DuckDB SQL, window by window.
ORACLE_SQL = rf"""
WITH words AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+'), []::VARCHAR[]) AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS p FROM words),
windows AS (SELECT doc_id, p, array_to_string(w[p : p + {WINDOW - 1}], ' ') AS s FROM starts),
firsts AS (SELECT s, min(doc_id) AS least FROM windows GROUP BY s),
repeats AS (SELECT doc_id, p FROM windows JOIN firsts USING (s) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + {WINDOW})) AS p FROM repeats),
marked AS (SELECT doc_id, list(p) AS gone FROM gone GROUP BY doc_id)
SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w
    ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
FROM words LEFT JOIN marked USING (doc_id)"""
