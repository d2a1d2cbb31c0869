import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clauselake.llm import labelled, quality, toxicity

SF = "/root/testdata/sf0.1"


def held_out(spark, scored, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    rows = scored.join(labels, "doc_id").filter("held_out").toPandas()
    y, p = rows.y.to_numpy(), rows.predicted.to_numpy()
    order = rows.score.rank().to_numpy()
    auc = (order[y == 1].mean() - (y.sum() + 1) / 2) / (len(y) - y.sum())
    return auc, p[y == 1].mean(), p[y == 0].mean()


def test_quality_on_held_out_rows(spark):
    scored = quality.score_quality(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    auc, kept, wrong = held_out(spark, scored, "quality")
    assert auc > 0.95 and kept > 0.97 and wrong < 0.3


def test_toxicity_on_held_out_rows(spark):
    scored = toxicity.score_toxicity(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    auc, caught, wrong = held_out(spark, scored, "toxic")
    assert auc > 0.88 and caught > 0.45 and wrong < 0.05  # about 300 toxic rows teach here


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_odd_inputs(spark, score):
    schema, labels = "doc_id long, text string, score string", "doc_id long, quality int, toxic int"
    rows = [(1, None, "a"), (2, "", "b"), (2, "", "b"), (3, "x", None), (None, "word " * 20000, "c"), (4, "ünï " * 9, "d")]
    df = spark.createDataFrame(rows, schema)
    for lab in ([], [(1, 1, 0), (2, 0, 1)], [(3, 1, 0), (4, 0, 1), (4, 0, 1), (2, 1, 0), (5, None, None), (None, 1, 1)], [(3, 1, 1), (3, 0, 0)]):
        got = score(df, spark.createDataFrame(lab, labels)).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
        assert len({r.score for r in got if r.doc_id == 2}) == 1
    assert score(df.limit(0), spark.createDataFrame([], labels)).count() == 0


def test_drop_toxic_keeps_columns(spark):
    r = random.Random(1)
    plain, bad = [f"word{i}" for i in range(300)], ["grubble", "snarfish", "vermoid"]
    rows = []
    for i in range(400):
        words = r.choices(plain, k=120)
        if i % 4 == 0:
            for _ in range(12):
                words[r.randrange(120)] = r.choice(bad)
        rows.append((i, " ".join(words), "s", {"a": 1}))
    df = spark.createDataFrame(rows, "doc_id long, text string, `_w` string, m map<string,int>")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 400, 2)] + [(i, 0) for i in range(1, 300, 6)], "doc_id long, toxic int")
    kept = toxicity.drop_toxic(df, labels)
    assert kept.columns == df.columns
    ids = {x.doc_id for x in kept.collect()}
    assert len(ids & set(range(0, 400, 4))) <= 5 and len(ids - set(range(0, 400, 4))) >= 295


def test_toxic_words_that_ordinary_rows_quote_are_learned():
    """Each toxic word also occurs in one ordinary row."""
    r = random.Random(2)
    plain, bad = [f"word{i}" for i in range(300)], ["grubble", "snarfish", "vermoid"]
    rows = []
    for i in range(400):
        words = r.choices(plain, k=120)
        for _ in range(12 if i % 4 == 0 else 0):
            words[r.randrange(120)] = r.choice(bad)
        if i in (1, 101, 201):
            words[60] = bad[i // 100]
        rows.append([w.encode() for w in words])
    toxic = [ws for i, ws in enumerate(rows) if i % 4 == 0]
    clean = [ws for i, ws in enumerate(rows) if i % 4]
    assert {w.encode() for w in bad} <= {w for ws in clean[:200] for w in ws}
    model = toxicity.Model(clean[:200], toxic[:60])
    measure = toxicity.Distance(model)
    score = lambda rows: model.score(np.array([measure.document(ws) for ws in rows]))
    assert all(w.encode() in model.front for w in bad)
    assert (score(toxic[60:]) >= 0.7).mean() >= 0.9 and (score(clean[200:]) >= 0.7).mean() <= 0.05


def test_long_clean_texts_are_not_toxic(spark):
    """Of 20 000 and 100 000 words from held-out ordinary rows; with toxic rows among them they are."""
    documents, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(documents, labels, learn=toxicity._learn(3, 1))
    held = documents.join(labels, "doc_id").filter((labelled.fold(F.col("doc_id"), 3) == 1) & F.col("text").isNotNull())
    texts = {c: [toxicity.words(r.text) for r in held.filter(F.col("toxic") == c).orderBy("doc_id").collect()] for c in (0, 1)}
    clean = [w for ws in texts[0] for w in ws if len(ws) < 2000]
    measure = toxicity.Distance(model)
    score = lambda ws: model.score(np.array([measure.document(ws)]))[0]
    assert [score(clean[at : at + n]) < 0.7 for n in (20_000, 100_000) for at in (0, 20_000, 40_000)] == [True] * 6
    assert score([w for ws in texts[1] for w in ws][:20_000]) >= 0.7
    assert not texts[0] or (np.array([score(ws) for ws in texts[0][:300]]) >= 0.7).mean() < 0.05


def test_threshold_is_reached_by_at_most_the_share():
    model = toxicity.Model([], [])
    for found in ([0] * 900 + [3] * 99 + [5], [0] * 990 + [2] * 10, [0, 1], [], [4] * 1000):
        model.calibrate(found)
        assert sum(d >= model.least for d in found) <= toxicity.FALSE_SHARE * len(found)
        assert model.least <= 2 or sum(d >= model.least - 1 for d in found) > toxicity.FALSE_SHARE * len(found)


def test_sample_is_bounded_and_consistent(spark):
    docs = spark.createDataFrame([(i, "t") for i in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(0, 1)], "doc_id long, quality int")
    got = labelled.sample(docs, labels, "quality", F.col("doc_id") != 3, (10, 60)).toPandas()
    assert (got.label == 0).sum() == 10 and (got.label == 1).sum() == 49 and not {0, 3} & set(got.doc_id)


def test_dual_descent_separates():
    rng = np.random.default_rng(1)
    rows = [np.array([0, 1]) if i % 2 else np.array([1, 2]) for i in range(40)]
    y = np.where(np.arange(40) % 2, 1.0, -1.0)
    w = quality.descend(rows, [rng.random(2) + 0.5 for _ in rows], y, np.full(40, 10.0), 3)
    assert w[0] > 0 > w[2]
