"""Quality classifier: naive Bayes support vectors.

A document's features are the hashed n-grams of its bytes, present or not.
Each feature is scaled by its class log-count ratio, documents are scaled to
unit length, and a linear hinge-loss model is fitted by dual coordinate
descent.  A logistic curve on rows kept from that fit turns margins into
scores.  Fitting uses a bounded sample of labelled rows (``ROWS`` of each
class); scoring is one narrow pass over whole texts.

Cases: a null or empty text (under three bytes) has no features and gets the
score of margin 0; extra columns are not read; repeated rows score alike;
without labelled rows of both classes every score is the share of class 1
(0.5 without any); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.llm import labelled, scan

#: At most so many labelled rows of class 0 and 1 fit the model.
ROWS = (3000, 3000)
GRAMS = (3, 4)
BITS = 16
THRESHOLD = 0.3
SLICE_BYTES = 1 << 20
#: Hinge-loss cost, passes over the sample, and the smoothing of counts.
COST, EPOCHS, SMOOTH = 4.0, 40, 1.0


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) pairs, distinct and sorted."""
    raw, at = scan.as_bytes(texts)
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(at)) << np.uint64(BITS)
    wide = raw.astype(np.uint64)
    found = []
    for n in GRAMS:
        m = len(raw) - n + 1
        if m <= 0:
            continue
        code = np.full(m, n, np.uint64)
        for j in range(n):
            code = (code << np.uint64(8)) | wide[j : j + m]
        one = doc[:m] == doc[n - 1 :]
        found.append((doc[:m] | (scan.mix(code) >> np.uint64(64 - BITS)))[one])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint16)
    keys = np.sort(np.concatenate(found))
    if len(keys):
        keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
    return (keys >> np.uint64(BITS)).astype(np.int64), (keys & np.uint64(2**BITS - 1)).astype(np.uint16)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in scan.slices(batch.column("text"), SLICE_BYTES):
            part = batch.slice(lo, hi - lo)
            doc, code = features(part.column("text"))
            cut = np.searchsorted(doc, np.arange(len(part) + 1))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(
                [code[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())], names=["doc_id", "label", "codes"])


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, dims: int, epochs: int = EPOCHS) -> np.ndarray:
    """Dual coordinate descent for min |w|^2 / 2 + sum of cost * hinge."""
    w, alpha = np.zeros(dims), np.zeros(len(rows))
    norm = np.array([v @ v for v in values])
    order = np.random.default_rng(0)
    for _ in range(epochs):
        most = 0.0
        for i in order.permutation(len(rows)):
            if norm[i] == 0:
                continue
            grad = y[i] * (w[rows[i]] @ values[i]) - 1
            new = min(max(alpha[i] - grad / norm[i], 0.0), cost[i])
            if (step := new - alpha[i]) != 0.0:
                w[rows[i]] += step * y[i] * values[i]
                alpha[i] = new
                most = max(most, abs(step) * norm[i])
        if most < 1e-3:
            break
    return w


class Model:
    """Weight of each feature (ratio and model in one) and the score curve."""

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray):
        dims = 2**BITS
        self.weight, self.slope, self.base = np.zeros(dims, np.float32), 0.0, 0.0
        if len(labels) == 0 or labels.min() == labels.max():
            share = labels.mean() if len(labels) else 0.5
            self.base = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
            return
        counts = [SMOOTH + sum((np.bincount(r, minlength=dims) for r, k in zip(rows, labels) if k == c), np.zeros(dims)) for c in (0, 1)]
        ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
        values = [ratio[r] / np.sqrt(max(1, len(r))) for r in rows]
        y = np.where(labels == 1, 1.0, -1.0)
        share = np.array([(labels == 0).mean(), (labels == 1).mean()])
        cost = COST * 0.5 / share[labels]
        # the curve is fitted on margins that a model without those rows gives
        part = np.arange(len(rows)) % 4 == 3
        fit = np.flatnonzero(~part)
        w = descend([rows[i] for i in fit], [values[i] for i in fit], y[fit], cost[fit], dims)
        margin = np.array([w[r] @ v for r, v in zip(rows, values)])
        part = part if part.any() and labels[part].min() != labels[part].max() else ~part
        slope, self.base = labelled.logistic(margin[part][:, None], labels[part])
        self.slope = float(slope[0])
        self.weight = (descend(rows, values, y, cost, dims) * ratio).astype(np.float32)

    def scores(self, texts: pa.Array) -> np.ndarray:
        doc, code = features(texts)
        size = np.bincount(doc, minlength=len(texts))
        total = np.bincount(doc, self.weight[code], minlength=len(texts))
        return labelled.sigmoid(self.slope * total / np.sqrt(np.maximum(1, size)) + self.base)


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", learn=None, rows: tuple[int, int] = ROWS) -> Model:
    chosen = labelled.sample(documents, labels, label, F.lit(True) if learn is None else learn, rows)
    got = sorted(chosen.mapInArrow(_sampled, "doc_id long, label int, codes binary").collect())
    return Model([np.frombuffer(r.codes, np.uint16).astype(np.int64) for r in got], np.array([r.label for r in got], np.int64))


@scan.lean
def _scored(batches: Iterator[pa.RecordBatch], model: Model, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in scan.slices(batch.column("text"), SLICE_BYTES):
            part = batch.slice(lo, hi - lo)
            score = model.scores(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score),
                                              pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])


def score_quality(documents: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; rows of the held
    fold teach nothing."""
    model = fit(documents, labels, "quality", labelled.fold(F.col("doc_id"), folds) != held)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (labelled.fold(F.col("doc_id"), folds) == held).alias("held_out"), "text")
    return rows.mapInArrow(lambda it: _scored(it, model, threshold), "doc_id long, held_out boolean, score double, predicted int")
