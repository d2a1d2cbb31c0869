"""Training, learned boundaries and summaries: how often rows are passed over and moved."""

import re

from pyspark.sql import functions as F

from clauselake.functions.text import is_section_header, more_words_than
from clauselake.operators import boundary as B
from clauselake.operators import ml
from clauselake.operators import prep as D
from clauselake.operators import summary as M
from clauselake.plans import train as T


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stratified_split_leaves_rows_where_they_are(spark):
    rows = [(i, f"text {i}", "ab"[i % 2]) for i in range(40)] + [(7, "copy", "b")] * 30 + [(None, "no id", None)] * 10 + [(99, "one", "c")]
    got = D.split_stratified(spark.createDataFrame(rows, "doc_id long, text string, label string"))
    p = plan(got)
    assert not re.search(r"Exchange (hash|range|RoundRobin)", p) and "Sort" not in p and "Window" not in p
    test = {(r.label, r.split): r["count"] for r in got.groupBy("label", "split").count().collect()}
    assert test == {("a", "test"): 4, ("a", "train"): 16, ("b", "test"): 10, ("b", "train"): 40,
                    (None, "test"): 2, (None, "train"): 8, ("c", "train"): 1}


def test_rows_are_computed_once_for_a_split_and_a_fit(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    rows = [(i, ("cat sat here " if i % 2 else "dog ran off ") * 3, "ab"[i % 2]) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string").withColumn("text", counted("text"))
    model, test = ml.train_and_hold_out(df, max_iter=5)
    assert test.count() == 4 and seen.value == 20
    assert {r.label for r in ml.predict_clauses(model, test).filter("label = predicted").collect()} == {"a", "b"}


def test_vocabulary_ties_go_by_code_point(spark):
    df = spark.createDataFrame([(["b", "a", "b", "d", "c"],), ([],), (["a"],)], "_terms array<string>")
    counter = ml.featurizer().getStages()[4].copy().setVocabSize(3)
    assert ml.counted_terms(df, counter).vocabulary == ["a", "b", "c"]


def test_metrics_are_staged(spark, tmp_path, monkeypatch):
    took = []
    monkeypatch.setattr(T, "staged", lambda df, name: took.append(name) or df)
    base = spark.createDataFrame([(i, f"Signed by Oak{i} Corp on 1/2/2020 for {'rent' if i % 2 else 'sale'}.", i % 2) for i in range(20)], "doc_id long, text string, k int")
    notes = "array<struct<entity:string,start:int,end:int,label:string,clause_type:string,summary:string>>"
    annotated = base.select("doc_id", "text", F.array(F.struct(
        F.lit("Signed").alias("entity"), F.lit(0).alias("start"), F.lit(6).alias("end"), F.lit("PARTY").alias("label"),
        F.when(F.col("k") == 0, "SALE").otherwise("RENT").alias("clause_type"), F.lit("Signed.").alias("summary"))).cast(notes).alias("annotations"))
    T.prepare_all(annotated, str(tmp_path))
    out = T.train_all(spark, str(tmp_path), max_iter=5)
    assert took == ["metrics"] * 4 and set(out) == {"classifier", "ner", "tagger", "summarization"}


def test_type_counts_read_neighbours_as_rows(spark):
    d = spark.createDataFrame([("No. 7 came. The cat! the cat. Go",), (None,), ("",), ("One.",)], "text string")
    counts = B.type_counts(d)
    assert "lambda" not in plan(counts)
    got = {(r.type, r.next): tuple(r)[2:] for r in counts.collect()}
    assert got == {("no", "#"): (1, 0, 0, 0, 0), ("#", None): (0, 1, 0, 0, 0), ("came", None): (1, 0, 1, 0, 0), ("the", None): (0, 2, 1, 0, 1),
                   ("cat", None): (1, 1, 2, 0, 0), ("go", None): (0, 1, 0, 0, 1), ("one", None): (1, 0, 0, 0, 0)}


def test_terms_are_asked_once_for_a_text(spark):
    texts = ["The KEY part of this is here. Nothing else of it was seen. Then the deadline and the goal came.", None, "", "No sentence",
             "A key \u0001 part of the sentence here. Next step of it is there."]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for out in (M.summarize(d), M.summarize_legal(d)):
        p = out._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "_joined" in p and out.count() == len(texts)
    # a separator inside a given sentence does not shift the others
    given = d.limit(1).withColumn("s", F.array(F.lit("One two \u0001 three four."), F.lit("The main goal is the key result."), F.lit("Five six seven eight.")))
    assert M.with_summary(given, sents_col="s").count() == 1
    kept = M._with_terms(given, F.col("s"), F.array(F.lit("goal"), F.lit("zzz")), lambda t: t).first()
    assert kept._terms == ["goal"] and kept._low[1] == "the main goal is the key result." and len(kept._low) == 3


def test_word_bounds_and_headers(spark):
    s = spark.createDataFrame([(" a  b c",), ("a b",), ("",), (None,), ("Payment Terms:",), ("Payment Terms",), ("1. Payment",), ("A" + " b" * 30000,)], "s string")
    got = s.select(more_words_than("s", 2), is_section_header("s")).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, False), (False, False), (None, None), (False, True), (False, False), (False, True), (True, False)]
