"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text.
A document is cut into windows of ``WORDS`` words; each window is compressed
with the ordinary dictionary alone and with the toxic one in front, and its
distance is how many bytes the toxic dictionary saves.  Windows at or above a
threshold that at most ``FALSE_SHARE`` of ordinary windows reach count as toxic.
A logistic curve over how many there are, their share and the largest distance,
each beyond what as many ordinary windows show by chance, fitted with the rarer
class weighing more (root of the ratio), gives the score; so a text does not
become toxic by its length.

The toxic dictionary is trained on the distinct windows of toxic rows (copies
repeat theirs).  Windows are cut into segments, runs of words that are at least
``LIFT`` times as frequent in toxic windows as in ordinary ones, and a segment
counts as often as its largest ratio says; the words between count nothing, as
the ordinary dictionary has them.  Both rates are raised by ``FLOOR``, so a
word in a few toxic windows sets nothing apart and one that ordinary rows use
now and then (a quote, a wrong label) still does; ordinary windows with one do
not train the ordinary dictionary.  Without such a segment the windows train as
they are.

Fitting uses a bounded sample: ``ROWS`` labelled rows of each class and, for the
dictionaries and the threshold, at most ``SAMPLE_WINDOWS`` windows of each,
spread over the whole text.  The curve is fitted on whole texts, three numbers
for each from a Spark task.  Scoring is one narrow pass over whole texts.

Cases: a null or empty text has no windows and gets the score of none toxic;
extra columns are not read; repeated rows score alike; without labelled rows of
both classes every score is the share of class 1 (0 without any); an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.llm import labelled, scan
from clauselake.session import work_dir

#: At most so many labelled rows of class 0 and 1, and windows of each, fit.
ROWS, SAMPLE_WINDOWS = (3000, 2000), 400
WORDS = 8
THRESHOLD = 0.7
#: Bytes of the two dictionaries.
ORDINARY_BYTES, TOXIC_BYTES = 64 << 10, 2 << 10
#: Ordinary windows that reach the threshold, at most this share.
FALSE_SHARE = 0.003
#: A toxic segment's words are so many times as frequent as in ordinary windows;
#: the share of windows added to both rates.
LIFT, FLOOR = 3.0, 1 / 4000
#: Windows that train the ordinary dictionary and that set the threshold.
TRAIN, CALIBRATE = 60_000, 30_000
_CONTENT = b"\1\0\0\0\4\0\0\0\10\0\0\0"


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().split()


def windows(ws: list[bytes]) -> list[bytes]:
    return [b" " + b" ".join(ws[i : i + WORDS]) + b" " for i in range(0, len(ws), WORDS)]


def dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """Content of a dictionary trained on the samples; where they are too few
    to train on, the samples themselves."""
    try:
        trained = zstandard.train_dictionary(size, samples, k=segment, d=8).as_bytes()
        return trained[trained.index(_CONTENT) + len(_CONTENT) :]
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters(window_log=17, chain_log=17, hash_log=17, search_log=5, min_match=5, target_length=32,
                                              strategy=zstandard.STRATEGY_GREEDY, write_content_size=0, write_dict_id=0)
    d.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=how)


class Model:
    """Two dictionaries, the window threshold and the score curve."""

    def __init__(self, ordinary: list[list[bytes]], toxic: list[list[bytes]], whole=None):
        """``whole(model, picks)`` measures the rows ``picks`` of each class, from
        their whole texts; else they are measured as they are here."""
        self.slopes, self.base, self.least, self.tail = None, -30.0, 0, np.zeros(1)
        self.plain = self.front = b""
        if not ordinary or not toxic:
            share = len(toxic) / max(1, len(toxic) + len(ordinary))
            self.base = float(np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -30, 30))
            return
        # threshold and curve come from rows that teach the dictionaries nothing;
        # the dictionaries are then trained again on all rows
        picks = [list(range(3, len(c), 4)) for c in (ordinary, toxic)]
        picks = picks if all(picks) else [list(range(len(c))) for c in (ordinary, toxic)]
        apart = [[c[i] for i in at] for c, at in zip((ordinary, toxic), picks)]
        self._train(*([ws for i, ws in enumerate(c) if i % 4 != 3] or c for c in (ordinary, toxic)))
        measure = Distance(self)
        pool = sorted({w for ws in apart[0] for w in windows(ws)}, key=zlib.crc32)[:CALIBRATE]
        self.calibrate([measure.window(w) for w in pool])
        measure = Distance(self)
        seen = whole(self, picks) if whole else [[measure.document(ws) for ws in c] for c in apart]
        x, y = np.array([v for c in seen for v in c], float), np.repeat([0, 1], [len(c) for c in seen])
        self.slopes, self.base = labelled.logistic(x, y, np.where(y == 1, np.sqrt((len(y) - y.sum()) / y.sum()), 1.0))
        self._train(ordinary, toxic)

    def _train(self, ordinary: list[list[bytes]], toxic: list[list[bytes]]) -> None:
        plain, bad = ({w for ws in c for w in windows(ws)} for c in (ordinary, toxic))
        often = [Counter(x for w in c for x in set(w.split())) for c in (plain, bad)]
        lift = {x: (n / len(bad) + FLOOR) / (often[0][x] / max(1, len(plain)) + FLOOR) for x, n in often[1].items()}
        own = [w for w in sorted(plain, key=zlib.crc32) if all(lift.get(x, 0) < LIFT for x in w.split())]
        self.plain = dictionary(own[:TRAIN], ORDINARY_BYTES, 48)
        marks = []
        for w in sorted(bad):
            for set_apart, run in groupby(w.split(), lambda x: lift[x] >= LIFT):
                if set_apart:
                    run = list(run)
                    marks += [b" " + b" ".join(run) + b" "] * round(max(map(lift.__getitem__, run)))
        mixed = np.random.default_rng(0).permutation(len(marks))
        marks = [marks[i] for i in mixed]
        self.front = dictionary([b"".join(marks[i : i + 8]) for i in range(0, len(marks), 8)] or sorted(bad), TOXIC_BYTES, 32)

    def calibrate(self, ordinary: list[int]) -> None:
        """The share of ordinary windows at each distance or above, and the
        smallest threshold that at most ``FALSE_SHARE`` of them reach."""
        counts = np.bincount(np.maximum(ordinary or [0], 0))
        above = np.append(counts[::-1].cumsum()[::-1], 0)
        self.least = max(2, int(np.argmax(above <= FALSE_SHARE * above[0])))
        self.tail = np.maximum(above, 1) / above[0]  # what none reached, one more may

    def score(self, seen: np.ndarray) -> np.ndarray:
        return labelled.sigmoid((seen @ self.slopes if self.slopes is not None else 0.0) + self.base + np.zeros(len(seen)))


class Distance:
    """Window distances under one model."""

    def __init__(self, model: Model):
        self.least, self.tail = model.least, model.tail
        self.plain, self.both = compressor(model.plain or b" " * 16), compressor((model.plain + model.front) or b" " * 16)

    def window(self, window: bytes) -> int:
        return len(self.plain.compress(window)) - len(self.both.compress(window))

    def document(self, ws: list[bytes]) -> tuple[float, float, float]:
        """Log count and share of toxic windows beyond chance, and the largest
        distance that more windows reach than chance explains.  Chance is what as
        many ordinary windows hold and three standard deviations."""
        found = np.array([self.window(w) for w in windows(ws)], np.int64)
        if not len(found):
            return 0.0, 0.0, 0.0
        most = np.arange(1, max(13, self.least + 1))
        chance = len(found) * self.tail[np.minimum(most, len(self.tail) - 1)]
        beyond = np.maximum(0.0, len(found) - np.searchsorted(np.sort(found), most) - chance - 3 * np.sqrt(chance))
        n = float(beyond[self.least - 1])
        return float(np.log1p(n)), n / len(found), float(min(12, most[beyond > 0].max(initial=0)))


@scan.lean
def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a bounded number of windows of each text."""
    for batch in batches:
        out = []
        for text in batch.column("text").to_pylist():
            ws = words(text)
            n = -(-len(ws) // WORDS)
            if n > SAMPLE_WINDOWS:
                at = [i * n // SAMPLE_WINDOWS * WORDS for i in range(SAMPLE_WINDOWS)]
                ws = [w for a in at for w in ws[a : a + WORDS]]
            out.append(b" ".join(ws))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(out, pa.binary())], names=["doc_id", "label", "words"])


@scan.lean
def _measured(batches: Iterator[pa.RecordBatch], model: Model, ids: list[frozenset]) -> Iterator[pa.RecordBatch]:
    """The three numbers of the whole texts of the rows ``ids`` of each class."""
    measure = Distance(model)
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "label", "text")))
        found = [(c, *measure.document(words(t))) for i, c, t in rows if i in ids[c]]
        yield pa.RecordBatch.from_pylist([dict(zip(("label", "n", "share", "most"), f)) for f in found],
                                         pa.schema([("label", pa.int32()), *((c, pa.float64()) for c in ("n", "share", "most"))]))


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", learn=None, rows: tuple[int, int] = ROWS) -> Model:
    spark, place = documents.sparkSession, work_dir(documents.sparkSession, "toxicity")
    chosen = labelled.sample(documents, labels, label, F.lit(True) if learn is None else learn, rows)
    chosen.select("doc_id", "label", "text").write.parquet(place)  # read twice
    chosen = spark.read.schema("doc_id long, label int, text string").parquet(place)
    got = sorted(chosen.mapInArrow(_sampled, "doc_id long, label int, words binary").collect())
    parts = [[r for r in got if r.label == c] for c in (0, 1)]

    def whole(model: Model, picks: list[list[int]]) -> list[list[tuple]]:
        ids = [frozenset(part[i].doc_id for i in at) for part, at in zip(parts, picks)]
        found = sorted(chosen.mapInArrow(lambda it: _measured(it, model, ids), "label int, n double, share double, most double").collect())
        return [[tuple(r)[1:] for r in found if r.label == c] for c in (0, 1)]

    return Model(*([bytes(r.words).split() for r in part] for part in parts), whole)


@scan.lean
def _scored(batches: Iterator[pa.RecordBatch], model: Model, threshold: float) -> Iterator[pa.RecordBatch]:
    measure = Distance(model)
    for batch in batches:
        seen = [measure.document(words(t)) for t in batch.column("text").to_pylist()]
        score = model.score(np.array(seen, float).reshape(len(seen), 3))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names), pa.array(score, pa.float64()),
                                          pa.array((score >= threshold).astype(np.int32))], names=[*batch.schema.names, "_tx_score", "_tx_predicted"])


def _learn(folds: int, held: int):
    return labelled.fold(F.col("doc_id"), folds) != held


def score_toxicity(documents: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; rows of the held
    fold teach nothing."""
    model = fit(documents, labels, "toxic", _learn(folds, held))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = rows.mapInArrow(lambda it: _scored(it, model, threshold), "doc_id long, text string, _tx_score double, _tx_predicted int")
    return scored.select("doc_id", (labelled.fold(F.col("doc_id"), folds) == held).alias("held_out"),
                         F.col("_tx_score").alias("score"), F.col("_tx_predicted").alias("predicted"))


@scan.lean
def _clean(batches: Iterator[pa.RecordBatch], model: Model, threshold: float) -> Iterator[pa.RecordBatch]:
    """Whole rows that are not predicted toxic."""
    measure = Distance(model)
    for batch in batches:
        seen = [measure.document(words(t)) for t in batch.column("text").to_pylist()]
        yield batch.filter(pa.array(model.score(np.array(seen, float).reshape(len(seen), 3)) < threshold))


def drop_toxic(documents: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """The input's rows that are not predicted toxic, whatever its columns are
    called."""
    model = fit(documents, labels, "toxic", _learn(folds, held))
    return documents.mapInArrow(lambda it: _clean(it, model, threshold), documents.schema)
