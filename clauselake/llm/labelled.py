"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text (null: of nothing), modulo ``folds``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def sample(documents: DataFrame, labels: DataFrame, label: str, learn: Column, rows: tuple[int, int]) -> DataFrame:
    """doc_id, text, label of at most ``rows[c]`` labelled documents of each
    class ``c``: those with the smallest hash of their id among the rows where
    ``learn`` holds.  Ids with contradicting labels are left out.  The chosen
    ids are bounded by ``rows``, so they are broadcast to the text scan."""
    one = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("label"))
           .filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id")
           .agg(F.min("label").alias("label"), F.max("label").alias("_most")).filter("label = _most").filter(learn))
    order = [F.xxhash64("doc_id"), "doc_id"]
    picks = [one.filter(F.col("label") == c).orderBy(*order).limit(n).select("doc_id", "label") for c, n in enumerate(rows)]
    chosen = F.broadcast(picks[0].unionAll(picks[1]))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").isNotNull()).join(chosen, "doc_id")


def unused(rows: DataFrame, name: str) -> str:
    """A column name that ``rows`` doesn't have."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | float = 1.0, ridge: float = 1e-2, steps: int = 30) -> tuple[np.ndarray, float]:
    """Weights and intercept of a ridge logistic regression (Newton steps)."""
    x1 = np.concatenate((x, np.ones((len(x), 1))), 1)
    w = np.zeros(x1.shape[1])
    keep = np.full(len(w), ridge * max(1, len(x)) / 100)
    keep[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        grad = x1.T @ (weight * (p - y)) + keep * w
        step = np.linalg.solve((x1 * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x1 + np.diag(keep), grad)
        w -= step / max(1.0, np.abs(step).max() / 4)
    return w[:-1], float(w[-1])


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
