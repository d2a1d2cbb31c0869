"""Near-duplicate groups by SuperMinHash.

A document's set holds its distinct shingles of ``shingle`` words (words of the
whole text, A-Z folded; three unless given); with fewer words the whole sequence
is one.  Two documents are linked if 100 * |intersection| >= ``percent`` *
|union| (85 unless given).

1. Signatures.  In SuperMinHash every element runs through one random
   permutation of the slots; at rank j it offers j + (a number below 1) to the
   j-th slot of its permutation.  Ranks are worked off together for all
   documents of a slice, and a document stops at the rank that fills its last
   slot, since later ranks only offer more.
2. Equal sets are one class (128 bits of hash and the size), stood for by its
   smallest id; only these go on, so copies are never expanded.
3. Banding.  ``BANDS`` bands of ``ROWS`` slots, or what ``banding`` derives for
   another percentage; each member of a band's bucket
   is paired with the smallest id there, never with all.
4. Verification on the full sets, computed anew from the whole texts.
5. Union-find: within partitions of links first, then trees are joined across
   them by smallest neighbours and pointer jumping.
6. Buckets that still hold more than one component are compared in full, block
   by block, between components: pairs whose signatures agree on at least
   ``AGREE`` (or what ``banding`` says) of the slots are verified inside the block, only links leave it,
   and grouping is done again.  No bucket is capped.

Signatures, bucket members and texts of candidates are written to the shared
checkpoint folder and read from there, so a lost executor costs one step.

Cases: a null or empty text has no shingle and is linked with nothing; a null
id takes no part (no component, kept); rows that repeat an id get the component
of their own text; extra columns are not read (``keep_one`` passes them on); an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.llm import labelled, scan
from clauselake.session import ensure_checkpoint_dir, work_dir

SHINGLE = 3
PERCENT = 85
#: 25 bands of 5 slots miss a pair at 0.85 with probability 4e-7.
BANDS, ROWS = 25, 5
SLOTS = BANDS * ROWS
#: Share of equal slots below which a pair is not verified: four standard
#: deviations (of plain MinHash, SuperMinHash has less) under the threshold.
AGREE = 0.72
#: For another percentage: bands miss a pair at it with at most this probability,
#: of so many slots at most (their numbers are bytes).
MISS, MOST_SLOTS = 4.5e-7, 255
SLICE_BYTES = 1 << 20
#: Members and shingles of a block in the comparison of a bucket's components.
BLOCK, SHINGLES = 512, 400_000


def banding(percent: int) -> tuple[int, int, float]:
    """Bands, slots of a band, and the share of equal slots below which a pair
    isn't verified, for links at ``percent``."""
    if percent == PERCENT:
        return BANDS, ROWS, AGREE
    like = min(max(percent, 1), 100) / 100
    for rows in range(ROWS, 0, -1):
        bands = 1 if like == 1 else math.ceil(math.log(MISS) / math.log1p(-(like**rows)))
        if bands * rows <= MOST_SLOTS:
            return bands, rows, like - 4 * math.sqrt(like * (1 - like) / (bands * rows))
    raise ValueError(f"{MOST_SLOTS} slots are too few for links at {percent} %")


def sets(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and their n + 1 offsets."""
    w = scan.scan(texts, lower=True)
    grams = {k: scan.windows(w.hash, k) for k in range(1, shingle + 1)}
    found = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        k = min(shingle, b - a)
        found.append(np.unique(grams[k][a : b - k + 1]) if k else np.zeros(0, np.uint64))
    at = np.concatenate(([0], np.cumsum([len(f) for f in found], dtype=np.int64)))
    return np.concatenate(found) if found else np.zeros(0, np.uint64), at


def signatures(items: np.ndarray, at: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash of each set as 32-bit slots."""
    n = len(at) - 1
    doc = np.repeat(np.arange(n), np.diff(at))
    out = np.full(n * slots, 2**64 - 1, np.uint64)
    order = None
    for rank in range(slots):
        if not len(items):
            break
        x = scan.mix(items + np.uint64(0x9E3779B97F4A7C15 * (rank + 1) % 2**64))
        pick = rank + ((x & np.uint64(0xFFFFFFFF)) * np.uint64(slots - rank) >> np.uint64(32)).astype(np.int64)
        value = np.uint64(rank << 32) | (x >> np.uint64(32))
        if rank == 0:
            slot = pick
        else:
            rows = np.arange(len(items))
            slot = order[rows, pick].astype(np.int64)
            order[rows, pick] = order[:, rank]
            order[:, rank] = slot
        np.minimum.at(out, doc * slots + slot, value)
        if rank == slots - 1:
            break
        short = (out.reshape(n, slots) == np.uint64(2**64 - 1)).any(1)
        go = short[doc]
        if order is None:
            items, doc, pick = items[go], doc[go], pick[go]
            order = np.tile(np.arange(slots, dtype=np.uint8), (len(items), 1))
            order[np.arange(len(items)), pick] = 0
            order[:, 0] = pick
        elif not go.all():
            items, doc, order = items[go], doc[go], order[go]
    return (scan.mix(out) >> np.uint64(32)).astype(np.uint32).reshape(n, slots)


@scan.lean
def _sign(batches: Iterator[pa.RecordBatch], shingle: int, slots: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in scan.slices(batch.column("text"), SLICE_BYTES):
            part = batch.slice(lo, hi - lo)
            items, at = sets(part.column("text"), shingle)
            size = np.diff(at)
            sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(scan.mix(items ^ np.uint64(s)), dtype=np.uint64))) for s in (1, 2)]
            k1, k2 = ((s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums)
            sig = signatures(items, at, slots)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(size.astype(np.int64)), pa.array(k1), pa.array(k2),
                 pa.array([s.tobytes() if m else None for s, m in zip(sig, size)], pa.binary())], names=["doc_id", "n", "k1", "k2", "sig"])


@scan.lean
def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed = [press.compress((t or "").encode()) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(packed, pa.binary())], names=["id", "packed"])


@scan.lean
def _verify(batches: Iterator[pa.RecordBatch], percent: int, shingle: int) -> Iterator[pa.RecordBatch]:
    """Links among pairs of texts; rows with one ``a`` come one after another."""
    last, own = None, None
    for batch in batches:
        keep = []
        for a, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "packed_a", "packed_b"))):
            if a != last:
                last, own = a, _set(x, shingle)
            other = _set(y, shingle)
            both = len(np.intersect1d(own, other, assume_unique=True))
            keep.append(both > 0 and 100 * both >= percent * (len(own) + len(other) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _set(packed: bytes, shingle: int) -> np.ndarray:
    return sets(pa.array([zstandard.ZstdDecompressor().decompress(packed).decode()], pa.string()), shingle)[0]


def verified(texts: DataFrame, pairs: DataFrame, percent: int, shingle: int) -> DataFrame:
    """The pairs (a, b) that are linked; ``texts`` has id, packed."""
    of = lambda c: texts.select(F.col("id").alias(c), F.col("packed").alias(f"packed_{c}"))
    return pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "packed_a", "packed_b").mapInArrow(
        lambda it: _verify(it, percent, shingle), "a long, b long")


@scan.lean
def _local_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of one partition: (u, v) with v the root."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    rows = [(u, v) for u in parent if (v := root(u)) != u]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """``u, v``: each linked id with the smallest id it reaches, where that is
    not itself."""
    ensure_checkpoint_dir(links.sparkSession)
    edges = links.mapInArrow(_local_trees, "u long, v long").distinct().checkpoint()
    while True:
        low = edges.groupBy("u").agg(F.min("v").alias("m")).checkpoint()
        other = edges.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        joined = low.select("u", F.col("m").alias("v")).unionByName(other)
        # every end moves on to its own smallest neighbour
        up = low.select(F.col("u").alias("_u"), F.col("m").alias("_m"))
        new = (joined.join(up, F.col("v") == F.col("_u"), "left")
               .select("u", F.coalesce("_m", "v").alias("v"), F.col("_m").isNotNull().alias("moved")))
        new = new.groupBy("u", "v").agg(F.max("moved").alias("moved")).checkpoint()
        state = new.agg(F.count("*"), F.count_if("moved"), F.countDistinct("u")).first()
        edges = new.select("u", "v")
        if state[1] == 0 and state[0] == state[2]:
            return edges


def _cross(table: pa.Table, percent: int, shingle: int, bands: int, agree: float) -> pa.Table:
    """Links between components of one block (or of two) of a bucket.  A pair
    is looked at in the first band that both share, and not at all once links
    found here have joined its components."""
    side, doc, label, size = (table.column(c).to_numpy().copy() for c in ("side", "doc", "label", "n"))
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(len(doc), -1)
    packed, band, known = table.column("packed").to_pylist(), table.column("band")[0].as_py(), {}
    one = len(set(side.tolist())) < 2
    left = np.flatnonzero(side == side.min())
    right = left if one else np.flatnonzero(side == side.max())
    out = []

    def members(i: int) -> np.ndarray:
        if i not in known:
            known[i] = _set(packed[i], shingle)
        return known[i]

    for i in left.tolist():
        far = right[(label[right] != label[i]) & (100 * np.minimum(size[right], size[i]) >= percent * np.maximum(size[right], size[i]))]
        far = far[doc[far] > doc[i]] if one else far
        if not len(far):
            continue
        same = sig[far] == sig[i]
        first = same.reshape(len(far), bands, -1).all(2).argmax(1)
        for j in far[(same.mean(1) >= agree) & (first == band)].tolist():
            if label[i] == label[j]:
                continue
            both = len(np.intersect1d(members(i), members(j), assume_unique=True))
            if both and 100 * both >= percent * (size[i] + size[j] - both):
                out.append((min(doc[i], doc[j]), max(doc[i], doc[j])))
                label[label == label[j]] = label[i]
    return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})


def rest_links(members: DataFrame, labels: DataFrame, signed: DataFrame, texts: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Links between components that still share a bucket: each such bucket is
    cut into blocks of bounded members and shingles, and each two blocks (and
    each one with itself) are compared in a task of their own."""
    named = members.join(labels.select(F.col("u").alias("doc"), F.col("v").alias("_v")), "doc", "left").select(
        "key", "band", "doc", "n", F.coalesce("_v", "doc").alias("label"))
    size = F.greatest(F.ceil(F.col("c") / BLOCK), F.ceil(F.col("total") / SHINGLES))
    mixed = (named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("c"), F.sum("n").alias("total"))
             .filter("lo < hi and c > 2").select("key", size.alias("blocks")))
    rows = named.join(mixed, "key").withColumn("own", F.pmod(F.xxhash64("doc"), "blocks"))
    cells = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "key", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("own").alias("side"), "doc", "label", "n")
    cells = cells.join(signed.select(F.col("rep").alias("doc"), "sig"), "doc").join(texts.select(F.col("id").alias("doc"), "packed"), "doc")
    bands, _, agree = banding(percent)
    return cells.groupBy("key", "i", "j").applyInArrow(lambda t: _cross(t, percent, shingle, bands, agree), "a long, b long").distinct()


def groups(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    n_bands, width, _ = banding(percent)
    slots = n_bands * width
    spark = documents.sparkSession
    base = work_dir(spark, "near-dup")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    rows = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    signed = stored(rows.mapInArrow(lambda it: _sign(it, shingle, slots), "doc_id long, n long, k1 long, k2 long, sig binary"), "signatures")
    reps = stored(signed.filter("n > 0 and doc_id is not null").groupBy("n", "k1", "k2").agg(
        F.min("doc_id").alias("rep"), F.min_by("sig", "doc_id").alias("sig")), "classes")
    keys = F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), lambda i: F.xxhash64(i, F.substring("sig", i * (4 * width) + 1, F.lit(4 * width))))
    bands = reps.select(F.col("rep").alias("doc"), "n", F.posexplode(keys).alias("band", "key"))
    shared = bands.groupBy("key").agg(F.min("doc").alias("pivot"), F.count("*").alias("c")).filter("c > 1").select("key", "pivot")
    members = stored(bands.join(shared, "key"), "members")
    pivots = members.filter("doc = pivot").select(F.col("pivot").alias("p"), F.col("n").alias("pn")).distinct()
    pairs = members.filter("doc > pivot").select(F.col("pivot").alias("a"), F.col("doc").alias("b"), "n").distinct()
    fits = F.lit(100) * F.least("n", "pn") >= F.lit(percent) * F.greatest("n", "pn")
    pairs = stored(pairs.join(pivots, F.col("a") == F.col("p")).filter(fits).select("a", "b"), "pairs")
    asked = members.select(F.col("doc").alias("id")).distinct()
    texts = rows.select(F.col("doc_id").alias("id"), "text").mapInArrow(_squeeze, "id long, packed binary").join(asked, "id")
    texts = stored(texts, "texts")
    links = stored(verified(texts, pairs, percent, shingle), "links")
    found = components(links)
    more = stored(rest_links(members, found, reps, texts, percent, shingle), "more-links")
    if not more.isEmpty():
        found = components(links.unionByName(more))
    whole = reps.select("n", "k1", "k2", "rep").join(found.select(F.col("u").alias("rep"), "v"), "rep", "left").select(
        "n", "k1", "k2", F.coalesce("v", "rep").alias("component_id"))
    out = signed.select("doc_id", "n", "k1", "k2").join(whole, ["n", "k1", "k2"], "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def keep_one(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """The input's rows without those that a smaller id of their group stands
    for."""
    own = labelled.unused(documents, "_nd_id")
    gone = groups(documents, text, doc_id, percent, shingle).filter("not kept").select(F.col("doc_id").alias(own))
    return documents.join(gone, F.col(f"`{doc_id}`") == F.col(own), "left_anti")


#: The same groups in DuckDB SQL: all pairs that share a shingle, and the
#: smallest id that links reach.
ORACLE_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+'), []::VARCHAR[]) AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[p : p + {SHINGLE - 1}], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, least(len(w), 1)) + 1)) AS p FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= {PERCENT} * (x.n + y.n - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT words.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(words.doc_id, coalesce(b, words.doc_id)) AS component_id,
  words.doc_id <= coalesce(b, words.doc_id) AS kept
FROM words LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON least.a = words.doc_id"""
