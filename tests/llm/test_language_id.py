import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clauselake.llm import language_id as li

SF = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, lang string, score string, letter int"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = li.identify(docs).join(docs.select("doc_id", "lang", F.octet_length("text").alias("size")), "doc_id").toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    held = got[got.held_out]
    right = held.lang_pred == held.lang
    assert 0.3 < got.held_out.mean() < 0.37 and right.mean() > 0.99
    assert right[held["size"] < 100].mean() > 0.9
    assert min(right[held.lang == c].mean() for c in held.lang.unique()) > 0.97


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    net = li.Network(["a", "b", "c"], seed=2)
    for name in ("vectors", "filters", "shift", "out", "base"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    codes = li.windows(rng.integers(0, 256, 900).astype(np.uint8), np.array([0, 300, 600, 850]), np.array([300, 600, 640, 900]))
    y = np.array([0, 1, 2, 1])
    _, found = net.gradients(codes, y)
    for name, g in zip(("vectors", "filters", "shift", "out", "base"), found):
        p = getattr(net, name)
        flat = np.argsort(-np.abs(g).ravel())[:: max(1, g.size // 7)][:5]
        for i in flat.tolist():
            at = np.unravel_index(i, p.shape)
            if name == "filters" and net.mask[at] == 0:
                continue
            old, step = p[at], 1e-5
            p[at] = old + step
            up = net.gradients(codes, y)[0]
            p[at] = old - step
            down = net.gradients(codes, y)[0]
            p[at] = old
            if name == "vectors" and at[0] == li.PAD:
                continue
            assert g[at] == pytest.approx((up - down) / (2 * step), rel=1e-3, abs=1e-6)


def plain(net, raw):
    """One text, place by place."""
    total, n = np.zeros(len(net.languages)), len(raw)
    for a in range(0, n, li.WINDOW):
        codes = [*raw[a : a + li.WINDOW + li.WIDEST - 1]] + [li.PAD] * (li.WINDOW + li.WIDEST)
        best = np.full(len(net.shift), -np.inf)
        for i in range(li.WINDOW):
            best = np.maximum(best, np.concatenate([net.vectors[c] for c in codes[i : i + li.WIDEST]]) @ net.filters)
        z = np.maximum(best + net.shift, 0) @ net.out + net.base
        total += (z - np.log(np.exp(z).sum())) * min(li.WINDOW, n - a) / n
    share = np.exp(total) / np.exp(total).sum()
    return int(share.argmax()), share.max()


def test_scores_equal_a_plain_walk_over_the_text():
    net = li.Network(["a", "b", "c"], seed=5)
    r = random.Random(2)
    texts = ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 2000)])) for _ in range(n)) for n in (1, 3, 100, 255, 256, 257, 700)]
    best, share = net.predict(pa.array(texts))
    for text, b, s in zip(texts, best, share):
        want = plain(net, text.encode())
        assert want[0] == b and want[1] == pytest.approx(s, rel=1e-4)


def test_odd_inputs(spark):
    r = random.Random(1)
    kinds = (("x", 0, ["alpha", "beta", "gamma"]), ("y", 100, ["uno", "dos", "tres"]))
    rows = [(i + n, " ".join(r.choices(words, k=30)), lang, None, i) for lang, n, words in kinds for i in range(60)]
    odd = [(1000, None, "x", "s", 1), (1001, "", "y", "s", 1), (1002, "123 !?", "x", "s", 1), (1003, "alpha beta " * 60000, None, "s", 1),
           (None, "uno dos tres", "y", "s", 1), (1004, "uno dos", "", "s", 1), (1004, "uno dos", "", "s", 1), (1005, "ß", "x", None, 1)]
    df = spark.createDataFrame(rows + odd + [(7, "alpha beta gamma", "x", None, None)] * 300, SCHEMA)
    got = li.identify(df)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert by[1000] == by[1001] == by[1002] == [("und", 0.0)]
    assert by[1003][0][0] == "x" and by[None][0][0] == "y" and by[1004][0][0] == "y" and len(set(by[1004])) == 1
    assert {p for i, own in by.items() for p, _ in own} == {"x", "y", "und"} and all(0 <= s <= 1 for own in by.values() for _, s in own)
    assert li.identify(df.limit(0)).count() == 0
    one = li.identify(df.filter("lang = 'x' and doc_id < 60")).collect()
    assert {(r.lang_pred, r.score) for r in one} == {("x", 1.0)}
    assert {(r.lang_pred, r.score) for r in li.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {("und", 0.0)}


def test_sample_is_bounded_and_even(spark):
    rows = [(i, f"text {i}", "a" if i % 10 else "b") for i in range(3000)] + [(5, "again", "a")] * 2000
    got = li.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 100).toPandas()
    assert (got.lang == "a").sum() <= 50 and (got.lang == "b").sum() == 50 and got.doc_id.is_unique and (got.lang == "a").sum() > 30
