"""Quality rules: base counts and n-gram perplexity.

The language model is a modified Kneser-Ney model over byte trigrams of all
texts.  Spark counts the trigrams: each task adds up its own in sorted arrays,
so one row for each trigram and task is shuffled.  A trigram is three bytes, so
the tables have at most 2^24 entries whatever the corpus is (a proven bound of
192 MB for the driver and for each task; ordinary text uses about a hundredth).
The model is a sorted array of trigram codes (their hash, free of collisions)
with their log-probabilities, looked up by binary search.

A document's cross-entropy is the mean of -log2 p over its trigrams, and its
perplexity 2 to that power.  For each language, ``lower`` and ``upper`` come
from the quartiles of all its documents that pass the base rules: ``SPREAD``
interquartile ranges below and above the median.  Short texts vary more, so the
band widens by ``SHORT`` / sqrt(trigrams).  ``kept`` is false outside the band.

Cases: a null or empty text has no words and fails the base rules; a text
without trigrams has no perplexity and no band applies; a null language is a
language of its own; repeated rows are counted each; extra columns are not read
(``keep_good`` passes them on); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.llm import labelled, scan
from clauselake.session import work_dir

#: Fixed values of the base rules.
SYMBOLS, REPEAT, LEAST_WORDS, MOST_REPEATED = "#*$%&|<>", 5, 10, 20
#: Width of a language's band.
SPREAD, SHORT = 5.0, 12.0
SLICE_BYTES = 2 << 20
#: Languages up to this many are broadcast with their bands.
LANGUAGES = 10_000


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the trigrams of each text, and their text numbers."""
    raw, at = scan.as_bytes(texts)
    wide, n = raw.astype(np.uint32), len(raw) - 2
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    one = doc[:n] == doc[2:]
    return ((wide[:n] << 16) | (wide[1 : n + 1] << 8) | wide[2:])[one], doc[:n][one]


def _add(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    head = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, np.int64)
    return codes[head], np.add.reduceat(counts, head) if len(head) else counts


@scan.lean
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    for batch in batches:
        for lo, hi in scan.slices(batch.column("text"), SLICE_BYTES):
            c, n = np.unique(trigrams(batch.column("text").slice(lo, hi - lo))[0], return_counts=True)
            codes, counts = _add(np.concatenate((codes, c)), np.concatenate((counts, n)))
    for lo in range(0, len(codes), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(codes[lo : lo + (1 << 16)].astype(np.int32)), pa.array(counts[lo : lo + (1 << 16)])], names=["code", "n"])


def _discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and 3 or more."""
    n = np.bincount(np.minimum(counts, 5), minlength=6).astype(float)
    if not (n[1] and n[2]):
        return np.array([0, 0.5, 0.5, 0.5])
    y = n[1] / (n[1] + 2 * n[2])
    d = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.5 * k for k in (1, 2, 3)]
    return np.array([0.0, *(min(max(v, 0.0), float(k)) for k, v in enumerate(d, 1))])


class Model:
    """Sorted trigram codes and log2 probabilities."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        order = np.argsort(codes)
        self.codes, c3 = codes[order].astype(np.uint32), counts[order].astype(np.int64)
        # lower orders count the distinct bytes that come before
        c2, c1 = np.zeros(1 << 16, np.int64), np.zeros(256, np.int64)
        np.add.at(c2, (self.codes & 0xFFFF).astype(np.int64), 1)
        pairs = np.flatnonzero(c2)
        np.add.at(c1, pairs & 0xFF, 1)
        d1, d2, d3 = (_discounts(c[c > 0]) for c in (c1, c2, c3))
        left = d1[np.minimum(c1, 3)]
        total = max(1, int(c1.sum()))
        p1 = (c1 - left + left.sum() / 256) / total if c1.any() else np.full(256, 1 / 256)
        head, next_ = pairs >> 8, pairs & 0xFF
        sums, give = np.bincount(head, c2[pairs], 256), np.bincount(head, d2[np.minimum(c2[pairs], 3)], 256)
        p2 = p1[np.arange(1 << 16) & 0xFF] * np.repeat(np.where(sums > 0, give / np.maximum(sums, 1), 1.0), 256)
        p2[pairs] += (c2[pairs] - d2[np.minimum(c2[pairs], 3)]) / sums[head]
        context, low = (self.codes >> 8).astype(np.int64), (self.codes & 0xFFFF).astype(np.int64)
        off = d3[np.minimum(c3, 3)]
        sums, give = np.bincount(context, c3, 1 << 16), np.bincount(context, off, 1 << 16)
        p3 = (c3 - off) / sums[context] + give[context] / sums[context] * p2[low]
        self.bits = -np.log2(np.maximum(p3, 1e-30)).astype(np.float32) if len(p3) else np.zeros(0, np.float32)

    def entropies(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Mean bits of each text's trigrams (NaN: none), and how many."""
        codes, doc = trigrams(texts)
        at = np.minimum(np.searchsorted(self.codes, codes), max(0, len(self.codes) - 1))
        known = self.codes[at] == codes if len(self.codes) else np.zeros(len(codes), bool)
        bits = np.where(known, self.bits[at] if len(self.bits) else 0, 24.0)
        n = np.bincount(doc, minlength=len(texts))
        with np.errstate(invalid="ignore"):
            return np.bincount(doc, bits, len(texts)) / np.where(n, n, np.nan), n


def train(documents: DataFrame) -> Model:
    """The model of all texts of ``documents``."""
    rows = documents.select("text").mapInArrow(_count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    return Model(rows.column("code").to_numpy().astype(np.uint32), rows.column("n").to_numpy().astype(np.int64))


def repeated(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and those in 5-word windows that it has twice."""
    w = scan.scan(texts)
    n = len(w.hash) - REPEAT + 1
    covered = np.zeros(len(w.hash) + 1, np.int64)
    if n > 0:
        at = np.flatnonzero(w.doc[:n] == w.doc[REPEAT - 1 :])
        key = scan.windows(w.hash, REPEAT)[at] ^ scan.mix(w.doc[at].astype(np.uint64))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        np.add.at(covered, at[twice], 1)
        np.add.at(covered, at[twice] + REPEAT, -1)
    inside = np.cumsum(covered[:-1]) > 0
    total = np.concatenate(([0], np.cumsum(inside)))
    return np.diff(w.first), total[w.first[1:]] - total[w.first[:-1]]


def _text_counts(text: str) -> tuple[int, int, int]:
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines))


@scan.lean
def _measure(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in scan.slices(batch.column("text"), SLICE_BYTES):
            part = batch.slice(lo, hi - lo)
            n, again = repeated(part.column("text"))
            counts = np.array([_text_counts(t or "") for t in part.column("text").to_pylist()], np.int64).reshape(len(part), 3)
            bits, grams = model.value.entropies(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("lang"), *(pa.array(x.astype(np.int64)) for x in (n, *counts.T, again)),
                 pa.array(bits, pa.float64(), from_pandas=True), pa.array(grams.astype(np.int64))],
                names=["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "bits", "grams"])


def apply_rules(documents: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, lang, perplexity and its
    band of every document."""
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    model = spark.sparkContext.broadcast(train(rows))  # at most 2^24 codes of 8 bytes
    measured = rows.mapInArrow(lambda it: _measure(it, model), "doc_id long, lang string, n_words long, word_chars long, n_symbols long, "
                               "n_dup_lines long, n_repeat_words long, bits double, grams long")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    path = work_dir(spark, "quality-rules")
    measured.withColumn("base_failed", failed).write.parquet(path)
    measured = spark.read.parquet(path)
    marks = (measured.filter("not base_failed and bits is not null").groupBy("lang")
             .agg(F.percentile_approx("bits", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10_000).alias("q"))
             .select(F.col("lang").alias("_lang"), F.col("q")[1].alias("_mid"), (F.col("q")[2] - F.col("q")[0]).alias("_range")).checkpoint())
    marks = F.broadcast(marks) if marks.count() <= LANGUAGES else marks
    slack: Column = F.lit(SPREAD) * F.col("_range") + F.lit(SHORT) / F.sqrt(F.greatest("grams", F.lit(1)))
    out = measured.join(marks, F.col("lang").eqNullSafe(F.col("_lang")), "left").withColumns({"_low": F.col("_mid") - slack, "_high": F.col("_mid") + slack})
    inside = F.coalesce(F.col("bits").between(F.col("_low"), F.col("_high")), F.lit(True))
    two = F.lit(2.0)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"),
                      "lang", F.pow(two, "bits").alias("perplexity"), F.pow(two, "_low").alias("lower"), F.pow(two, "_high").alias("upper"))


def keep_good(documents: DataFrame) -> DataFrame:
    """The input's rows that the rules keep."""
    own = labelled.unused(documents, "_qr_id")
    good = apply_rules(documents).filter("kept").select(F.col("doc_id").alias(own)).distinct()
    return documents.join(good, F.col("doc_id").eqNullSafe(F.col(own)), "left_semi")
