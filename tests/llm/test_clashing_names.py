"""Columns that are called like an operator's working columns."""

import random

from clauselake.llm import near_dup, quality_rules, toxicity


def test_filters_keep_rows_whatever_their_columns_are_called(spark):
    r = random.Random(1)
    words = [f"word{i}" for i in range(80)]
    rows = [(i, " ".join(r.choices(words, k=40)), "en", i, i, i, i) for i in range(30)]
    rows += [(100, rows[0][1], "en", 0, 0, 0, 0), (101, None, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, _tx_score long, _nd_id long, _QR_ID long, _tx_predicted int"
    df = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    left = near_dup.keep_one(df)
    assert left.columns == df.columns and {x.doc_id for x in left.collect()} == {*range(30), 101}
    good = quality_rules.keep_good(df)
    assert good.columns == df.columns and {tuple(x) for x in good.collect()} <= set(rows)
    clean = toxicity.drop_toxic(df, labels)
    assert clean.columns == df.columns and clean.dtypes == df.dtypes and {tuple(x) for x in clean.collect()} <= set(rows)
