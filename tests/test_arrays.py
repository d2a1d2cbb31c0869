"""Expressions kept by column name are resolved against each query's own rows."""

from pyspark.sql import functions as F

from clauselake.functions.arrays import by_name
from clauselake.operators.entities import legal_entities


def test_one_expression_for_two_tables(spark):
    build = lambda c: F.upper(c)
    a, b = (spark.createDataFrame([(t,)], "t string") for t in ("x", "y"))
    assert by_name(build, "t") is by_name(build, "t")
    assert [d.select(by_name(build, "t")).first()[0] for d in (a, b)] == ["X", "Y"]
    joined = a.alias("a").crossJoin(b.withColumnRenamed("t", "u"))
    assert joined.select(by_name(build, "t"), by_name(build, "u")).first()[:] == ("X", "Y")


def test_entities_of_equally_named_tables(spark):
    a, b = (spark.createDataFrame([(1, t)], "doc_id long, text string") for t in ("Oak Corp lets it.", "Elm Ltd and Fir Inc."))
    assert [[r.text for r in legal_entities(d).collect()] for d in (a, b)] == [["Oak Corp"], ["Elm Ltd", "Fir Inc"]]
    other = b.withColumnRenamed("text", "body")
    assert [r.text for r in legal_entities(other, "body").collect()] == ["Elm Ltd", "Fir Inc"]
