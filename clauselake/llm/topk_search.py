"""Exact top-k search by exhaustive term-at-a-time accumulation.

Every component x becomes floor(256 * x); scores are integer inner products.
Candidates are dealt by id into blocks and queries into blocks of their own; a
cell holds one block of each, so no task sees more than two blocks however
large the table is, and each pair of rows meets in exactly one cell.  A cell
turns its candidates into postings (for each dimension, the rows whose
component isn't zero, and their weights).  The non-zero terms of a few queries
at a time then scatter their weighted postings into dense score arrays; a
partition selects each query's best, and the cells' winners are merged.

Cases: a vector that is null, empty or holds null or non-finite components
takes no part, nor does a null id; vectors of different lengths are compared as
if the shorter ended in zeros; an id that several rows carry is one query (by
its smallest vector), and one candidate for each row but that one; ties go to
the smaller id; scores beyond 64 bits rank exactly and are returned as the
nearest 64-bit value; extra columns are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 256
#: Rows of a block of candidates and of queries, at most.
BLOCK = 16_384
#: Smallest block worth a task of its own.
LEAST = 1024
#: Queries that accumulate at a time.
BATCH = 32


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of floor(256 * x), padded with zeros; Python integers where 64 bits
    might not do."""
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(rows.offsets.to_numpy())
    out = np.zeros((len(rows), int(size.max(initial=0))))
    out[np.arange(out.shape[1]) < size[:, None]] = np.floor(SCALE * rows.flatten().to_numpy())
    if np.abs(out).max(initial=0) < 2**53:
        return out.astype(np.int64)
    return np.array([[int(x) for x in row] for row in out.tolist()], object)


def accumulate(queries: np.ndarray, candidates: np.ndarray):
    """Score arrays of ``BATCH`` queries after the other."""
    dims = min(queries.shape[1], candidates.shape[1])
    most = [max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0)))) if m.dtype != object else max(map(abs, m.ravel().tolist()), default=0)
            for m in (queries, candidates)]
    kind = np.int32 if (bound := most[0] * most[1] * max(1, dims)) < 2**31 else np.int64 if bound < 2**62 else object
    queries, candidates = queries.astype(kind), candidates.astype(kind)
    postings = []
    for t in range(dims):
        at = np.flatnonzero(candidates[:, t])
        postings.append((slice(None) if len(at) == len(candidates) else at, np.ascontiguousarray(candidates[at, t])))
    for lo in range(0, len(queries), BATCH):
        part = queries[lo : lo + BATCH]
        scores = np.zeros((len(part), len(candidates)), kind)
        for t, (at, weight) in enumerate(postings):
            for row in np.flatnonzero(part[:, t]).tolist():
                scores[row, at] += part[row, t] * weight
        yield lo, scores


def best(scores: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the lower place; ``own`` is left
    out (-1: nothing)."""
    if own >= 0:
        scores = scores.copy()
        rest = np.delete(scores, own)
        if not len(rest):
            return np.zeros(0, np.int64)
        scores[own] = rest.min()
    n = len(scores) - (own >= 0)
    k = min(k, n)
    if k <= 0:
        return np.zeros(0, np.int64)
    cut = np.partition(scores, len(scores) - k)[len(scores) - k] if scores.dtype != object else sorted(scores.tolist())[-k]
    at = np.flatnonzero(scores >= cut)
    if own >= 0:
        at = at[at != own]
        if len(at) < k:  # the own row stood at the cut: all others with the least score
            at = np.delete(np.arange(len(scores)), own)
    return at[np.argsort(-scores[at], kind="stable")[:k]] if scores.dtype != object else np.array(sorted(at.tolist(), key=lambda i: (-scores[i], i))[:k], np.int64)


def _cell(table: pa.Table, k: int) -> pa.Table:
    """The best of one block of candidates for one block of queries."""
    table = table.sort_by([("is_query", "ascending"), ("id", "ascending")])
    ids, asks = table.column("id").to_numpy(), table.column("is_query").to_numpy(zero_copy_only=False)
    vectors = table.column("v")
    n = int((~asks).sum())
    out: tuple[list, list, list] = ([], [], [])
    if 0 < n < len(ids):
        candidates, queries = _matrix(vectors.slice(0, n)), _matrix(vectors.slice(n))
        width = max(candidates.shape[1], queries.shape[1])
        place = ids[:n]
        for lo, scores in accumulate(queries, candidates):
            for row in range(len(scores)):
                q = ids[n + lo + row]
                own = -1
                for i in range(*np.searchsorted(place, [q, q + 1]).tolist()):
                    if np.array_equal(_pad(candidates[i], width), _pad(queries[lo + row], width)):
                        own = i
                        break
                at = best(scores[row], own, k)
                out[0].extend([int(q)] * len(at))
                out[1].extend(place[at].tolist())
                out[2].extend(scores[row][at].tolist())
    return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()),
                     "score": pa.array([min(max(s, -(2**63)), 2**63 - 1) for s in out[2]], pa.int64()),
                     "beyond": pa.array([_beyond(s) for s in out[2]], pa.float64())})


def _beyond(score: int) -> float:
    """Orders scores that 64 bits cannot tell apart."""
    return float(score) if not -(2**63) <= score < 2**63 else 0.0


def _pad(v: np.ndarray, width: int) -> np.ndarray:
    return np.concatenate((v, np.zeros(width - len(v), v.dtype))) if len(v) < width else v


def search(vectors: DataFrame, every: int = 50, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best for each id divisible by
    ``every``."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{embedding}`").cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", finite))
    asked = rows.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    n, q = rows.select(F.count("*"), F.count_if(F.col("id") % every == 0)).first()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    s = max(-(-n // BLOCK), min(2 * cores, -(-n // LEAST)), 1)
    r = max(-(-q // BLOCK), 1)
    to = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    own = lambda blocks: F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    cells = rows.select(own(s).alias("s"), to(r).alias("r"), "id", "v", F.lit(False).alias("is_query")).unionByName(
        asked.select(to(s).alias("s"), own(r).alias("r"), "id", "v", F.lit(True).alias("is_query")))
    found = cells.groupBy("s", "r").applyInArrow(lambda t: _cell(t, k), "query_id long, vec_id long, score long, beyond double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same search in DuckDB SQL, for ids that one row each carries.
ORACLE_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored)
SELECT query_id, place::INT AS rank, vec_id, score FROM ranked WHERE place <= 5"""
