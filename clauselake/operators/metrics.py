"""Scoring, quality and evaluation.

Per-document metrics (A1, A5, A9, A10) are row-level expressions.  Corpus
metrics are aggregations with partial (map-side) aggregation, so a hot
label or key is pre-aggregated before the shuffle; the per-label tables
that come out are bounded by the label vocabulary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clauselake import vocab as V
from clauselake.functions.text import col_, sentence_array, word_count


# --- A1 ----------------------------------------------------------------------
def warnings_array(entities, sections, ratio) -> Column:
    """A1: fewer than 5 entity labels, fewer than 3 sections, ratio < 0.1."""
    entities, sections, ratio = col_(entities), col_(sections), col_(ratio)
    n_labels = F.size(F.array_distinct(F.transform(entities, lambda e: e["label"])))
    return F.array_compact(F.array(
        F.when(n_labels < 5, F.lit(V.WARN_ENTITIES)),
        F.when(F.size(sections) < 3, F.lit(V.WARN_SECTIONS)),
        F.when(F.coalesce(ratio, F.lit(0.0)) < 0.1, F.lit(V.WARN_SUMMARY))))


# --- A2 / A3 -----------------------------------------------------------------
_SPAN = ["doc_id", "start", "end", "label"]


def _flagged(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Distinct spans with whether they are predicted (``_p``) and gold
    (``_g``): both sides in one table, one aggregation by span."""
    both = pred.select(*_SPAN, F.lit(True).alias("_p"), F.lit(False).alias("_g")).unionByName(
        gold.select(*_SPAN, F.lit(False).alias("_p"), F.lit(True).alias("_g")))
    return both.groupBy(*_SPAN).agg(F.max("_p").alias("_p"), F.max("_g").alias("_g"))


def span_prf(pred: DataFrame, gold: DataFrame, labels=None) -> DataFrame:
    """A2: per-label precision/recall/F1 over distinct span sets, zero-safe,
    plus an 'overall' row = unweighted mean over all labels (seen or not).

    Plan: one partial aggregation by span with a flag for each side
    (``_flagged``), counted per label; the label dimension (fixed, 7 rows) is
    broadcast."""
    spark = pred.sparkSession
    counts = _flagged(pred, gold).groupBy("label").agg(
        F.count_if(F.col("_p") & F.col("_g")).alias("tp"),
        F.count_if(F.col("_p") & ~F.col("_g")).alias("fp"),
        F.count_if(~F.col("_p") & F.col("_g")).alias("fn"))
    labels = labels or [lab for lab, _ in V.ENTITY_TYPES]
    dim = F.broadcast(spark.createDataFrame([(lab,) for lab in labels], "label string"))
    t = dim.join(counts, "label", "left").fillna(0, ["tp", "fp", "fn"])
    prec = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    rec = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    t = t.withColumn("precision", prec).withColumn("recall", rec)
    t = t.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                  2 * F.col("precision") * F.col("recall")
                                  / (F.col("precision") + F.col("recall"))).otherwise(0.0))
    # 'overall' from window totals over the (fixed-size) label table,
    # emitted next to its first row: the span join runs once.
    w = Window.partitionBy()

    def row(label, tp, fp, fn, p, r, f):
        return F.struct(label.alias("label"), tp.cast("long").alias("tp"), fp.cast("long").alias("fp"),
                        fn.cast("long").alias("fn"), p.cast("double").alias("precision"),
                        r.cast("double").alias("recall"), f.cast("double").alias("f1"))

    t = (t.withColumn("_first", F.row_number().over(w.orderBy("label")) == 1)
         .withColumn("_tp", F.sum("tp").over(w)).withColumn("_fp", F.sum("fp").over(w))
         .withColumn("_fn", F.sum("fn").over(w)).withColumn("_p", F.avg("precision").over(w))
         .withColumn("_r", F.avg("recall").over(w)).withColumn("_f", F.avg("f1").over(w)))
    overall = row(F.lit("overall"), F.col("_tp"), F.col("_fp"), F.col("_fn"), F.col("_p"), F.col("_r"),
                  F.col("_f"))
    mine = row(F.col("label"), F.col("tp"), F.col("fp"), F.col("fn"), F.col("precision"), F.col("recall"),
               F.col("f1"))
    rows = F.when(F.col("_first"), F.array(mine, overall)).otherwise(F.array(mine))
    return t.select(F.inline(rows))


def span_diff(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """A3: each distinct span with its ``kind``: tp (on both sides), fp (only
    predicted) or fn (only gold)."""
    kind = F.when(F.col("_p") & F.col("_g"), "tp").when(F.col("_p"), "fp").otherwise("fn")
    return _flagged(pred, gold).select(*_SPAN, kind.alias("kind"))


# --- A4 ----------------------------------------------------------------------
def classification_report(df: DataFrame, label_col: str = "label", pred_col: str = "prediction") -> DataFrame:
    """A4: per-class precision/recall/F1/support, then 'accuracy' (f1 =
    accuracy, support = n), 'macro avg' and 'weighted avg' rows.  Classes
    are the union of true and predicted labels; 0 when undefined.

    Plan: one aggregation to (label, prediction) counts, one more to
    per-class counts (each pair feeds its true and its predicted class), and
    grouping sets (class), () over that table (bounded by the label
    vocabulary), whose total row gives the three summary rows; the input is
    read once."""
    pairs = df.groupBy(F.col(label_col).cast("string").alias("y"),
                       F.col(pred_col).cast("string").alias("p")).agg(F.count(F.lit(1)).alias("c"))
    zero = F.lit(0).cast("long")
    contrib = F.array(
        F.struct(F.col("y").alias("cls"), F.col("c").alias("support"), zero.alias("npred"),
                 F.when(F.col("y") == F.col("p"), F.col("c")).otherwise(zero).alias("tp")),
        F.struct(F.col("p").alias("cls"), zero.alias("support"), F.col("c").alias("npred"), zero.alias("tp")))
    t = pairs.select(F.inline(contrib)).groupBy("cls").agg(
        F.sum("support").alias("support"), F.sum("npred").alias("npred"), F.sum("tp").alias("tp"))
    prec = F.when(F.col("npred") > 0, F.col("tp") / F.col("npred")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    t = t.withColumn("precision", prec).withColumn("recall", rec)
    t = t.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                  2 * F.col("precision") * F.col("recall")
                                  / (F.col("precision") + F.col("recall"))).otherwise(0.0))
    share = F.col("support").cast("double")
    g = t.groupingSets([["cls"], []], "cls").agg(
        F.grouping_id().alias("_all"), F.sum("support").alias("n"), F.sum("tp").alias("tp"),
        *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")],
        *[F.sum(F.col(c) * share).alias(f"_{c}") for c in ("precision", "recall", "f1")])

    def row(label, p, r, f, n):
        return F.struct(label.alias("label"), p.cast("double").alias("precision"),
                        r.cast("double").alias("recall"), f.cast("double").alias("f1"),
                        n.cast("long").alias("support"))

    n = F.col("n")
    none = F.lit(None).cast("double")
    summary = F.array(
        row(F.lit("accuracy"), none, none, F.col("tp") / n, n),
        row(F.lit("macro avg"), F.col("precision"), F.col("recall"), F.col("f1"), n),
        row(F.lit("weighted avg"), *[F.col(f"_{c}") / n for c in ("precision", "recall", "f1")], n))
    each = F.array(row(F.col("cls"), F.col("precision"), F.col("recall"), F.col("f1"), n))
    return g.select(F.inline(F.when(F.col("_all") == 0, each).otherwise(summary)))


# --- A5 ----------------------------------------------------------------------
def _word_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), f"{V.WS}+"), lambda x: x != ""))


def word_overlap(pred, gold) -> Column:
    """A5: |distinct words of pred ∩ gold| / |distinct words of gold|."""
    g = _word_set(col_(gold))
    inter = F.size(F.array_intersect(_word_set(col_(pred)), g))
    return F.when(F.size(g) > 0, inter / F.size(g))


# --- A6 / A7 / A8 / A11 ------------------------------------------------------
def entity_stats(ents: DataFrame, thr: float = 0.7, by=("label",)) -> DataFrame:
    """Count and mean confidence per label after the threshold."""
    return ents.filter(F.col("confidence") >= thr).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("avg_confidence"))


def label_distribution(ents: DataFrame, label_col: str = "label") -> DataFrame:
    """Counts per label (bar) and share of all mentions (pie).  The
    share's window runs over the already-aggregated label table."""
    c = ents.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def clause_stats(sections: DataFrame, thr: float = 0.7) -> DataFrame:
    """Count and mean confidence per clause type after the threshold."""
    return sections.filter(F.col("confidence") >= thr).groupBy("type").agg(
        F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("avg_confidence"))


def label_options(ents: DataFrame, label_col: str = "label") -> DataFrame:
    """Distinct labels."""
    return ents.select(label_col).distinct()


# --- A9 / A10 ----------------------------------------------------------------
def clause_metrics(sections: DataFrame) -> DataFrame:
    """Per clause: confidence, word count, sentence count."""
    return sections.withColumn("n_words", word_count("text")).withColumn(
        "n_sentences", F.size(sentence_array(F.col("text"))))


def document_kpis(df: DataFrame, thr: float = 0.7, id_col: str = "doc_id") -> DataFrame:
    """A10 over analysis rows (``entities`` and ``sections`` arrays):
    entities >= thr, clauses >= thr, mean confidence over all entities."""
    ents, secs = F.col("entities"), F.col("sections")
    return df.select(
        id_col,
        F.size(F.filter(ents, lambda e: e["confidence"] >= thr)).alias("n_entities"),
        F.size(F.filter(secs, lambda s: s["confidence"] >= thr)).alias("n_clauses"),
        F.when(F.size(ents) > 0, F.aggregate(ents, F.lit(0.0), lambda a, e: a + e["confidence"])
               / F.size(ents)).alias("avg_confidence"))
