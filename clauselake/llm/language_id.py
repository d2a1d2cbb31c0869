"""Language identification by a byte convolutional network.

Each byte has a vector; filters of several widths slide over the bytes, each
keeps its highest value in a window (max pooling), and a softmax layer over those
gives the window's log-probability of each language.  A text is cut into windows
of ``WINDOW`` bytes, all of them scored in batches; their log-probabilities,
weighted by the bytes each window holds, are averaged and made into a
distribution, whose most likely language is the prediction and whose share is
the score.

The network is trained in numpy (Adam on cross entropy) on windows of a bounded
sample of labelled rows: ``ROWS`` documents dealt evenly to the languages (at
most the ``LANGUAGES`` with most rows), chosen by a hash of their id, at most
``TRAIN_WINDOWS`` windows each, spread over the text, and a short piece of one, so
that short texts are learned too.  Scoring is one narrow pass over whole texts.

Cases: a null text or one without a letter is ``und`` with score 0; very long
texts are scored whole, memory follows a slice of about ``SLICE_BYTES`` or the
longest text; repeated rows get equal results, and an id that several rows carry
teaches with one of them; null or empty ``lang`` and texts without a letter teach
nothing; with one language all other texts are that one with score 1, without any
all are ``und``; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauselake.llm import labelled, scan

WINDOW, VECTOR = 256, 8
WIDTHS, FILTERS = (2, 3, 4, 5), 16
WIDEST, PAD = max(WIDTHS), 256
UNKNOWN, LETTER = "und", r"\p{L}"
#: Bounds of the training sample.
ROWS, LANGUAGES, TRAIN_WINDOWS = 2400, 64, 2
EPOCHS, BATCH, RATE = 6, 32, 4e-3
#: Steps of training at least, where the sample is small.
LEAST_STEPS = 300
SLICE_BYTES = 1 << 20
#: Windows that are scored at a time.
SCORED = 96
_SPAN = WINDOW + WIDEST - 1


def windows(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Bytes ``start`` to ``end`` of each window, padded to ``_SPAN``."""
    at = start[:, None] + np.arange(_SPAN)
    inside = at < end[:, None]
    out = np.full(at.shape, PAD, np.int16)
    out[inside] = raw[at[inside]]
    return out


class Network:
    """Byte vectors, filters (narrow ones padded with zeros to ``WIDEST``), and
    the softmax layer over the pooled filters."""

    def __init__(self, languages: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        n = FILTERS * len(WIDTHS)
        self.languages = languages
        self.mask = np.repeat(np.concatenate([np.arange(WIDEST)[:, None] < w for w in WIDTHS], 1), VECTOR, 0)
        self.mask = np.repeat(self.mask, FILTERS, 1).astype(np.float32)  # (WIDEST * VECTOR, n)
        self.vectors = rng.normal(0, 0.5, (257, VECTOR)).astype(np.float32)
        self.vectors[PAD] = 0
        self.filters = (rng.normal(0, 0.25, self.mask.shape) * self.mask).astype(np.float32)
        self.shift = np.zeros(n, np.float32)
        self.out = rng.normal(0, 0.1, (n, len(languages))).astype(np.float32)
        self.base = np.zeros(len(languages), np.float32)

    def _spans(self, codes: np.ndarray) -> np.ndarray:
        """The vectors that each place's filters see: (windows, places, WIDEST * VECTOR)."""
        rows = np.ascontiguousarray(self.vectors[codes])
        a, b, c = rows.strides
        return np.lib.stride_tricks.as_strided(rows, (len(codes), WINDOW, WIDEST * VECTOR), (a, b, c))

    def _pooled(self, codes: np.ndarray, places: bool = False):
        spans = self._spans(codes)
        seen = (np.ascontiguousarray(spans).reshape(-1, WIDEST * VECTOR) @ self.filters).reshape(len(codes), WINDOW, -1)
        if not places:
            return np.maximum(seen.max(1) + self.shift, 0)
        at = seen.argmax(1)
        best = np.take_along_axis(seen, at[:, None], 1)[:, 0] + self.shift
        return np.maximum(best, 0), at, spans

    def log_shares(self, codes: np.ndarray) -> np.ndarray:
        """Log-probability of each language for each window."""
        z = self._pooled(codes) @ self.out + self.base
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def gradients(self, codes: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy and its gradients by parameter."""
        n = len(codes)
        pooled, at, spans = self._pooled(codes, places=True)
        z = pooled @ self.out + self.base
        z -= z.max(1, keepdims=True)
        share = np.exp(z)
        share /= share.sum(1, keepdims=True)
        loss = float(-np.log(share[np.arange(n), y] + 1e-12).mean())
        share[np.arange(n), y] -= 1
        share /= n
        back = (share @ self.out.T) * (pooled > 0)  # (windows, filters), at the place that each filter kept
        kept = spans[np.arange(n)[:, None], at]  # (windows, filters, WIDEST * VECTOR)
        d_filters = np.einsum("nf,nfk->kf", back, kept, optimize=True) * self.mask
        d_spans = (back[:, :, None] * self.filters.T[None]).reshape(-1, VECTOR)
        seen = np.take_along_axis(codes, (at[:, :, None] + np.arange(WIDEST)).reshape(n, -1), 1).ravel()
        d_vectors = np.stack([np.bincount(seen, d_spans[:, k], minlength=257) for k in range(VECTOR)], 1).astype(np.float32)
        d_vectors[PAD] = 0
        return loss, [d_vectors, d_filters.astype(np.float32), back.sum(0), pooled.T @ share, share.sum(0)]

    def train(self, codes: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        own = [self.vectors, self.filters, self.shift, self.out, self.base]
        first, second, step = [np.zeros_like(p) for p in own], [np.zeros_like(p) for p in own], 0
        epochs = max(epochs, -(-LEAST_STEPS // -(-len(y) // BATCH)))
        total = epochs * -(-len(y) // BATCH)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for lo in range(0, len(y), BATCH):
                part = order[lo : lo + BATCH]
                _, found = self.gradients(codes[part], y[part])
                step += 1
                rate = RATE * (1 - 0.9 * step / total)
                for p, m, v, g in zip(own, first, second, found):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The most likely language (its number) of each text and its share; a text
        without bytes gets what the base alone says."""
        raw, at = scan.as_bytes(texts)
        size = np.diff(at)
        many = -(-size // WINDOW)
        text = np.repeat(np.arange(len(texts)), many)
        begin = at[:-1][text] + WINDOW * (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many))
        held = np.minimum(WINDOW, at[1:][text] - begin)
        total = np.zeros((len(texts), len(self.languages)))
        for lo in range(0, len(text), SCORED):
            part = slice(lo, lo + SCORED)
            found = self.log_shares(windows(raw, begin[part], at[1:][text[part]]))
            np.add.at(total, text[part], found * held[part, None])
        total /= np.maximum(1, size)[:, None]
        share = np.exp(total - total.max(1, keepdims=True))
        share /= share.sum(1, keepdims=True)
        best = share.argmax(1)
        return best, share[np.arange(len(best)), best]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Some windows of each sampled text, as bytes."""
    for batch in batches:
        out = []
        for text in batch.column("text"):
            raw = text.as_buffer().to_pybytes()
            many = min(TRAIN_WINDOWS, max(1, len(raw) // WINDOW))
            spare = max(0, len(raw) - _SPAN)
            out.append([raw[a : a + _SPAN] for a in (spare * i // max(1, many - 1) for i in range(many))])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(out, pa.list_(pa.binary()))], names=["doc_id", "lang", "cuts"])


def sample(rows: DataFrame, total: int = ROWS) -> DataFrame:
    """doc_id, lang, cuts of at most ``total`` documents, as many of each language.

    Ids are thinned by a hash before anything is shuffled, so a language with a
    third of all rows, or an id with as many, sends no more than any other."""
    known = rows.filter((F.col("lang") != "") & F.col("text").rlike(LETTER) & F.col("doc_id").isNotNull())
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    each = max(1, total // max(1, len(counts)))
    spark = rows.sparkSession
    limits = spark.createDataFrame([(r.lang, min(1.0, 2 * each / r.n)) for r in counts], "lang string, part double")  # at most LANGUAGES rows
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) / F.lit(float(1 << 31))
    thin = known.select("doc_id", "lang").join(F.broadcast(limits), "lang").filter(place < F.col("part"))
    thin = thin.groupBy("doc_id").agg(F.min("lang").alias("lang"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = thin.withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= each).select("doc_id", "lang")  # at most total rows
    one = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    texts = known.join(F.broadcast(chosen), ["doc_id", "lang"]).withColumn("_nth", F.row_number().over(one)).filter("_nth = 1")
    return texts.select("doc_id", "lang", "text").mapInArrow(_cut, "doc_id long, lang string, cuts array<binary>")


def fit(rows: DataFrame, total: int = ROWS) -> Network | None:
    """A network trained on ``rows`` (doc_id, lang, text); None without any."""
    got = sorted((r.doc_id, r.lang, [bytes(c) for c in r.cuts]) for r in sample(rows, total).collect())
    languages = sorted({lang for _, lang, _ in got})
    if not languages:
        return None
    rng = np.random.default_rng(0)
    cuts, y = [], []
    for _, lang, own in got:
        size = int(rng.integers(6, 100))
        begin = int(rng.integers(0, max(1, len(own[-1]) - size)))
        own.append(own[-1][begin : begin + size])  # a short one, from a random place
        cuts += own
        y += [languages.index(lang)] * len(own)
    raw = np.frombuffer(b"".join(cuts), np.uint8)
    end = np.cumsum([len(c) for c in cuts])
    network = Network(languages)
    network.train(windows(raw, end - [len(c) for c in cuts], end), np.array(y))
    return network


@scan.lean
def _predicted(batches: Iterator[pa.RecordBatch], network: Network | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in scan.slices(batch.column("text"), SLICE_BYTES):
            part = batch.slice(lo, hi - lo)
            letters = part.column("letter").to_numpy(zero_copy_only=False).astype(bool)
            names, score = np.full(len(part), UNKNOWN, object), np.zeros(len(part))
            if network is not None and letters.any():
                best, share = network.predict(part.column("text").filter(pa.array(letters)))
                names[letters], score[letters] = np.array(network.languages, object)[best], share
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(score)],
                                             names=["doc_id", "held_out", "lang_pred", "score"])


def identify(documents: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; rows of the held
    fold teach nothing."""
    doc_id = F.col("doc_id").cast("long")
    apart = labelled.fold(doc_id, folds) == held
    text = F.col("text").cast("string")
    network = fit(documents.filter(~apart).select(doc_id.alias("doc_id"), F.col("lang").cast("string").alias("lang"), text.alias("text")))
    rows = documents.select(doc_id.alias("doc_id"), apart.alias("held_out"), F.coalesce(text.rlike(LETTER), F.lit(False)).alias("letter"), text.alias("text"))
    return rows.mapInArrow(lambda it: _predicted(it, network), "doc_id long, held_out boolean, lang_pred string, score double")
