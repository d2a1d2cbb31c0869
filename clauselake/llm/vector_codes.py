"""Vector code compression: product codes with integer codebooks.

Each component x becomes floor(4096 * x); a vector is cut into 8 consecutive
parts and each part is replaced by the index of the nearest entry of its
position's codebook of 16.  Codebooks start from the smallest ids and are
refined by 6 rounds of assigning and averaging, all in whole numbers, so reruns
and other partitionings give the same bytes.

Distances come from lexicographic tries: the distinct parts of ``TRIE_ROWS``
vectors, sorted, share a node for each common prefix of dimensions.  A traversal
from the root, depth first and a block of neighbouring nodes at a time, hands
each node the squared distances to all entries that its parent has added up, so
a prefix is added once for all parts below it; a leaf takes the least entry and
adds its part, weighted by how often it occurs, to that entry's sums.  Sums are
added up in Spark and only the codebooks (8 x 16 entries) come to the driver.

The tries' sorted parts are written once to the shared work folder and read in
each round; there is no shuffle of vectors, and a vector that a third of all rows
carry is one leaf of each trie.

Cases: a vector that is null, empty or holds null or non-finite components is
dropped, and so is a row without an id; vectors of other lengths, or of lengths
that 8 doesn't divide, are read as if they ended in zeros up to the longest
one's length rounded up; of an id that several rows carry the smallest vector
starts an entry, and all its rows are coded; with fewer than 16 ids codebooks are
shorter; components beyond 2**62 are taken as that, and errors beyond 64 bits as
the largest 64-bit value; extra columns are not read, a missing label column
counts as nulls; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.llm import scan
from clauselake.session import work_dir

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Vectors whose parts share a trie, and nodes that a step of the traversal opens.
TRIE_ROWS, BLOCK = 32_768, 16_384
_LIMIT, _MOST = 1 << 62, (1 << 63) - 1


def whole(rows: pa.ListArray, width: int) -> np.ndarray:
    """floor(SCALE * x) of each vector, padded with zeros to ``width``; Python
    integers where distances might leave 64 bits."""
    size = np.diff(rows.offsets.to_numpy())
    flat = rows.flatten().to_numpy()
    if np.abs(flat).max(initial=0) < 2**40:
        out = np.zeros((len(rows), width), np.int64)
        out[np.arange(width) < size[:, None]] = np.floor(SCALE * flat).astype(np.int64)
        return _narrow(out)
    out = np.zeros((len(rows), width), object)
    out[np.arange(width) < size[:, None]] = np.array(
        [min(max(int(x) * SCALE if abs(x) >= 2**53 else int(np.floor(SCALE * x)), -_LIMIT), _LIMIT) for x in flat.tolist()], object)
    return out


def _narrow(values: np.ndarray) -> np.ndarray:
    """64-bit integers where no sum of squared differences (of two values of this
    size) leaves 64 bits, Python integers elsewhere."""
    most = max(abs(int(values.max(initial=0))), abs(int(values.min(initial=0))))
    return values if (2 * most + 1) ** 2 * max(1, values.shape[-1]) < _MOST else values.astype(object)


class Trie:
    """Distinct parts, sorted, as a trie: for each depth the values of its nodes,
    the parent of each and the first child of each."""

    def __init__(self, parts: np.ndarray, weight: np.ndarray):
        """``parts``: distinct rows in lexicographic order."""
        self.parts, self.weight = parts, weight
        n, width = parts.shape
        fresh = np.zeros(n, bool)
        fresh[:1] = True
        node = np.zeros(n, np.int64)
        self.values, self.parent, self.child = [], [], []
        for d in range(width):
            fresh[1:] |= (parts[1:, d] != parts[:-1, d]).astype(bool)
            first = np.flatnonzero(fresh)
            self.values.append(parts[first, d])
            self.parent.append(node[first])
            above = len(self.values[-2]) if d else 1
            self.child.append(np.searchsorted(node[first], np.arange(above + 1)))
            node = np.cumsum(fresh) - 1

    def leaves(self, book: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first leaf, last + 1, squared distances to all entries) in leaf order."""
        stack = [(0, 0, 1, np.zeros((1, len(book)), book.dtype))]
        while stack:
            depth, lo, hi, added = stack.pop()
            if depth == len(self.values):
                yield lo, hi, added
                continue
            child = self.child[depth]
            a, z = int(child[lo]), int(child[hi])
            if z - a > BLOCK and hi - lo > 1:  # the left half of the nodes is opened first
                mid = (lo + hi) // 2
                stack += [(depth, mid, hi, added[mid - lo :]), (depth, lo, mid, added[: mid - lo])]
                continue
            for b in range(a + (z - a - 1) // BLOCK * BLOCK, a - 1, -BLOCK):
                e = min(b + BLOCK, z)
                off = self.values[depth][b:e, None] - book[None, :, depth]
                stack.append((depth + 1, b, e, added[self.parent[depth][b:e] - lo] + off * off))

    def nearest(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each distinct part (ties: the first) and its
        squared distance."""
        kind = object if self.parts.dtype == object or book.dtype == object else np.int64
        best, error = np.zeros(len(self.parts), np.int64), np.zeros(len(self.parts), kind)
        for a, z, distance in self.leaves(book.astype(kind)):
            best[a:z] = distance.argmin(1)
            error[a:z] = distance[np.arange(z - a), best[a:z]]
        return best, error

    def sums(self, book: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
        """(entry, parts that are nearest to it, their componentwise sum)."""
        best, _ = self.nearest(book)
        weighted = self.parts * self.weight[:, None].astype(self.parts.dtype)
        for entry in np.unique(best).tolist():
            own = best == entry
            yield entry, int(self.weight[own].sum()), weighted[own].sum(0).tolist()


def distinct(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows in lexicographic order, how often each occurs, and the place
    of each row among them."""
    order = np.lexsort(parts.T[::-1]) if parts.dtype != object else np.array(sorted(range(len(parts)), key=lambda i: tuple(parts[i])), np.int64)
    ordered = parts[order]
    fresh = np.ones(len(parts), bool)
    fresh[1:] = (ordered[1:] != ordered[:-1]).any(1)
    place = np.empty(len(parts), np.int64)
    place[order] = np.cumsum(fresh) - 1
    return ordered[fresh], np.bincount(place), place


def _chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of ``rows`` rows (the last one fewer), whatever the batches are."""
    held, n = [], 0
    for batch in batches:
        while len(batch):
            part = batch.slice(0, rows - n)
            held.append(part)
            n += len(part)
            batch = batch.slice(len(part))
            if n == rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _lists(column: pa.ChunkedArray) -> pa.ListArray:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


@scan.lean
def _tries(batches: Iterator[pa.RecordBatch], width: int, trie_rows: int) -> Iterator[pa.RecordBatch]:
    """The distinct parts of each trie: position, whether numbers are 64-bit, the
    parts' numbers and how often each occurs."""
    step = width // PARTS
    for table in _chunks(batches, trie_rows):
        values = whole(_lists(table.column("v")), width)
        for part in range(PARTS):
            rows, weight, _ = distinct(values[:, part * step : (part + 1) * step])
            wide = values.dtype == object
            numbers = "\n".join(map(str, rows.ravel().tolist())).encode() if wide else rows.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([wide]), pa.array([numbers], pa.binary()),
                                              pa.array([weight.astype(np.int64).tobytes()], pa.binary())], names=["part", "wide", "numbers", "weight"])


@scan.lean
def _least_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ``ENTRIES`` smallest ids of a task."""
    least = np.zeros(0, np.int64)
    for batch in batches:
        least = np.unique(np.concatenate((least, batch.column(0).to_numpy())))[:ENTRIES]
    yield pa.RecordBatch.from_arrays([pa.array(least)], names=["vec_id"])


def _stored(numbers: bytes, weight: bytes, wide: bool, step: int) -> Trie:
    values = np.array([int(x) for x in numbers.split(b"\n")], object) if wide else np.frombuffer(numbers, np.int64)
    return Trie(values.reshape(-1, step), np.frombuffer(weight, np.int64))


@scan.lean
def _sums(batches: Iterator[pa.RecordBatch], books: list[np.ndarray], step: int) -> Iterator[pa.RecordBatch]:
    """Partial sums of a task's tries: one row for each dimension of each entry."""
    total: dict = {}
    for batch in batches:
        for part, wide, numbers, weight in zip(*(c.to_pylist() for c in batch.columns)):
            for entry, n, added in _stored(numbers, weight, wide, step).sums(books[part]):
                old = total.get((part, entry))
                total[part, entry] = (n, added) if old is None else (old[0] + n, [x + y for x, y in zip(old[1], added)])
    rows = [(part, entry, d, n, s) for (part, entry), (n, added) in total.items() for d, s in enumerate(added)]
    columns = list(zip(*rows)) or [[]] * 5
    halves = [[s >> 32 for s in columns[4]], [s & 0xFFFFFFFF for s in columns[4]]]  # sums of any size as two decimals
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
    yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds)), pa.array([str(x) for x in halves[0]], pa.string()),
                                      pa.array(halves[1], pa.int64())], names=["part", "entry", "dim", "n", "high", "low"])


@scan.lean
def _coded(batches: Iterator[pa.RecordBatch], books: list[np.ndarray], width: int, trie_rows: int) -> Iterator[pa.RecordBatch]:
    step = width // PARTS
    for table in _chunks(batches, trie_rows):
        values = whole(_lists(table.column("v")), width)
        codes, errors = [], 0
        for part in range(PARTS):
            rows, weight, place = distinct(values[:, part * step : (part + 1) * step])
            best, error = Trie(rows, weight).nearest(books[part])
            codes.append(best[place])
            errors = errors + error[place].astype(object)
        code = np.stack(codes, 1).astype(np.uint8).tobytes().hex()
        whole_error = [min(int(x), _MOST) for x in errors.tolist()]
        yield pa.RecordBatch.from_arrays([table.column("vec_id").combine_chunks(), table.column("label").combine_chunks(),
                                          pa.array([code[i : i + 2 * PARTS] for i in range(0, len(code), 2 * PARTS)], pa.string()),
                                          pa.array(whole_error, pa.int64())], names=["vec_id", "label", "code", "error"])


def _usable(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    named = F.col(f"`{label}`").cast("string") if label in vectors.columns else F.lit(None).cast("string")
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), named.alias("label"), F.col(f"`{embedding}`").cast("array<double>").alias("v"))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", finite))


def train(rows: DataFrame, width: int, rounds: int = ROUNDS, trie_rows: int = TRIE_ROWS) -> list[np.ndarray]:
    """A codebook for each part position, from usable ``rows`` (vec_id, v)."""
    spark, step = rows.sparkSession, width // PARTS
    ids = rows.select("vec_id").mapInArrow(_least_ids, "vec_id long").distinct().orderBy("vec_id").limit(ENTRIES).collect()
    first = rows.filter(F.col("vec_id").isin([r.vec_id for r in ids])).groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").collect()
    start = whole(pa.array([list(r.v) for r in first], pa.list_(pa.float64())), width)
    books = [start[:, p * step : (p + 1) * step] for p in range(PARTS)]
    path = work_dir(spark, "vector_codes") + "/tries"
    rows.select("v").mapInArrow(lambda it: _tries(it, width, trie_rows), "part int, wide boolean, numbers binary, weight binary").write.parquet(path)
    tries = spark.read.parquet(path)
    for _ in range(rounds):
        added = tries.mapInArrow(lambda it, books=books: _sums(it, books, step), "part int, entry int, dim int, n long, high string, low long")
        got = added.groupBy("part", "entry", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("high").cast("decimal(38,0)")).alias("high"),
                                                        F.sum(F.col("low").cast("decimal(38,0)")).alias("low")).collect()
        fresh = [b.astype(object) for b in books]
        for r in got:
            fresh[r.part][r.entry, r.dim] = ((int(r.high) << 32) + int(r.low)) // r.n
        books = [_narrow(b.astype(np.int64)) for b in fresh]
    return books


def book_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def encode(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
           trie_rows: int = TRIE_ROWS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable vector.

    Coded rows are written to the shared work folder: label sums and result read
    them.  Label sums are joined back null-safely; whether they are broadcast is
    decided at run time by their size."""
    spark = vectors.sparkSession
    rows = _usable(vectors, vec_id, embedding, label)
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    width = -(-longest // PARTS) * PARTS
    books = train(rows, width, trie_rows=trie_rows)
    path = work_dir(spark, "vector_codes") + "/coded"
    rows.mapInArrow(lambda it: _coded(it, books, width, trie_rows), "vec_id long, label string, code string, error long").write.parquet(path)
    coded = spark.read.parquet(path)
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.least(total, F.lit(_MOST)).cast("long").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").select(
        "vec_id", "code", "error", "label_error", F.lit(book_digest(books)).alias("codebooks_sha256"))


def decode(codes: str, books: list[np.ndarray]) -> list[float]:
    """The vector that a code stands for."""
    return [int(x) / SCALE for p, b in enumerate(books) for x in b[int(codes[2 * p : 2 * p + 2], 16)].tolist()]
