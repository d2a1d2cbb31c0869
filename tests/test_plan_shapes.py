"""Plans that stay in the row or read their input once, and what they give."""

import random
import time

import pytest
from pyspark.sql import functions as F

from clauselake.operators import entities as E
from clauselake.operators import metrics as A
from clauselake.operators import segment as G
from clauselake.operators import summary as M


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tfidf_summary_stays_in_the_row(spark):
    d = spark.createDataFrame([(1, "One word here. " * 3)], "doc_id long, text string")
    p = plan(M.summarize_tfidf(d))
    assert "Exchange" not in p and "Window" not in p and "Join" not in p


def test_tfidf_summary_by_hand(spark):
    text = "Rent rent pier. Oak pier. The of. Oak oak oak moor."
    got = M.summarize_tfidf(spark.createDataFrame([(1, text)], "doc_id long, text string"), max_length=2).first()
    # terms of each sentence (stop words out, with bigrams) and their idf over four sentences
    import math

    rows = [["rent", "rent", "pier", "rent rent", "rent pier"], ["oak", "pier", "oak pier"], [], ["oak", "oak", "oak", "moor", "oak oak", "oak oak", "oak moor"]]
    idf = {t: math.log(5 / (1 + sum(t in r for r in rows))) + 1 for r in rows for t in r}
    w = [[r.count(t) * idf[t] for t in set(r)] for r in rows]
    score = [sum(x) / math.sqrt(sum(v * v for v in x)) if x else 0.0 for x in w]
    best = sorted(sorted(range(4), key=lambda i: (-score[i], -i))[:2])
    sents = ["Rent rent pier.", "Oak pier.", "The of.", "Oak oak oak moor."]
    assert (got.summary, got.original_length, got.summary_length) == (" ".join(sents[i] for i in best), 4, 2)


def test_tfidf_vocabulary_cut_and_odd_texts(spark):
    text = " ".join(f"Common term{i % 7} word{i}." for i in range(200))
    d = spark.createDataFrame([(1, text), (2, None), (3, "  "), (4, "! ? . " * 200), (5, "a b. " * 160)], "doc_id long, text string")
    rows = {r.doc_id: r for r in M.summarize_tfidf(d, max_length=150, max_features=8).collect()}
    assert rows[1].summary_length == 150 and rows[1].original_length == 200
    assert (rows[2].summary, rows[3].summary, rows[2].compression_ratio) == ("", "", 0.0)
    assert rows[5].summary_length == 150  # no sentence has a term: the later ones


def test_heading_sections_are_one_aggregation(spark):
    paras = spark.createDataFrame([(1, 0, "H", True), (1, 1, "b", None), (2, 0, "1. FIRST", False)], "doc_id long, para_no long, text string, is_heading boolean")
    df = G.heading_sections(paras)
    assert plan(df).count("Exchange") == 1 and "Window" not in plan(df) and "Union" not in plan(df)
    assert sorted(map(tuple, df.collect())) == [(1, 0, "H", "H\nb"), (2, 0, "1. FIRST", "1. FIRST")]


@pytest.mark.parametrize("seed", range(4))
def test_overlap_by_halving_equals_every_pair(spark, seed):
    r = random.Random(seed)
    spans, at = [], 0
    for _ in range(r.choice([0, 1, 2, 7, 40])):
        at += r.randrange(4)
        spans.append((at, at + r.randrange(1, 5)))
        at = spans[-1][1]
    asked = [(a, a + r.randrange(1, 9)) for a in range(-2, at + 6)]
    df = spark.createDataFrame([([tuple(s) for s in spans], a, z) for a, z in asked], "spans array<struct<start:int,end:int>>, start int, end int")
    got = df.select(F.transform(F.array(F.struct("start", "end")), lambda x: E._overlaps(F.col("spans"), x))[0]).collect()
    assert [x[0] for x in got] == [any(s < z and a < e for s, e in spans) for a, z in asked]


def test_many_hits_of_both_kinds(spark):
    text = "Oak Corp met indemnification and liability of Party B. " * 20_000
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    n = E.legal_entities(d).groupBy("source").count().collect()
    assert {x.source: x["count"] for x in n}["ner"] == 40_000 and time.time() - began < 60


def test_report_equals_the_ml_evaluator(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    r = random.Random(5)
    rows = [(float(y), float(y if r.random() < 0.7 else r.randrange(4))) for y in r.choices(range(4), [5, 3, 1, 1], k=500)]
    df = spark.createDataFrame(rows, "label double, prediction double")
    report = {x.label: x for x in A.classification_report(df).collect()}
    for metric, row, field in (("f1", "weighted avg", "f1"), ("weightedPrecision", "weighted avg", "precision"), ("weightedRecall", "weighted avg", "recall"), ("accuracy", "accuracy", "f1")):
        assert report[row][field] == pytest.approx(MulticlassClassificationEvaluator(metricName=metric).evaluate(df))
    assert report["weighted avg"].support == 500 and len(report) == 7
    assert "SinglePartition" not in plan(A.classification_report(df)) and A.classification_report(df.limit(0)).count() == 0


def test_contexts_from_pieces_equal_those_from_the_text(spark):
    from clauselake.functions.text import cut, cut_context, pieces_of, span_context

    r = random.Random(9)
    rows = []
    for n in (0, 1, 5, 1023, 1024, 1025, 2048, 5000):
        text = "".join(r.choice("aé😀 \n") for _ in range(n))
        for _ in range(12):
            a = r.randrange(n + 1)
            rows.append((text, a, r.randrange(a, n + 1)))
    df = spark.createDataFrame(rows, "t string, a int, z int")
    got = df.select("t", "a", "z", cut(pieces_of("t"), F.col("a"), F.col("z")).alias("cut"), cut_context(pieces_of("t"), F.col("a"), F.col("z")).alias("near"),
                    span_context("t", "a", "z").alias("want")).collect()
    assert all(x.cut == x.t[x.a : x.z] and x.near == x.want for x in got)


def test_spans_by_one_scan_equal_those_by_two(spark):
    """Texts without the mark are scanned once; one with it gives the same spans."""
    import re

    r = random.Random(11)
    texts = [None, "", "Party A", "no match here", "Party B.", "\U0001f600 Party A\u0002 Party B \u0002", "$5 $6", "\\$7 $0 $1", "\n\nParty Z\n"]
    texts += ["".join(r.choice(["Party A", "Party", " ", "é", "\U0001f600", "\n", "$12", "x", "\u0001"]) for _ in range(r.choice([3, 30, 900]))) for _ in range(40)]
    texts += [t + "\u0002" for t in texts[9:20]]
    pattern = r"\bParty [A-Z]\b|\$[0-9]+"
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    one = df.filter("i <> 5 AND i < 49").select(E.regex_spans("t", pattern).alias("s"))
    assert "regexp_replace" in plan(one)
    for x in df.select("i", "t", E.regex_spans("t", pattern).alias("s")).collect():
        want = None if x.t is None else [(m.group(), m.start(), m.end()) for m in re.finditer(pattern, x.t, re.A if "é" not in x.t else 0)]
        assert (None if x.s is None else [tuple(s) for s in x.s]) == want
