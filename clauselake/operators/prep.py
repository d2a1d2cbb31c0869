"""Dataset preparation over nested annotations.

Splits are exact (``ceil(test_size * n)`` test rows) without a
single-partition global sort: rows get a seeded md5 key, the keys are
range-partitioned, per-partition counts (one small row per partition) locate
the partition that holds the cut, and only that partition's keys are
ranked.  The result is a threshold key; the split itself is a filter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clauselake.session import ensure_checkpoint_dir, staged

ANNOTATION = ("struct<entity:string,start:int,end:int,label:string,"
              "clause_type:string,summary:string>")


# --- D1 / D2 / D3 ------------------------------------------------------------
def prepare_ner(df: DataFrame) -> DataFrame:
    """Spans of annotations that carry an entity; docs without any are
    dropped.  (doc_id, text, entities array<struct<start,end,label>>)."""
    ents = F.transform(F.filter("annotations", lambda a: a["entity"].isNotNull()),
                       lambda a: F.struct(a["start"].alias("start"), a["end"].alias("end"),
                                          a["label"].alias("label")))
    return df.select("doc_id", "text", ents.alias("entities")).filter(F.size("entities") > 0)


def prepare_classifier(df: DataFrame) -> DataFrame:
    """label = clause_type of the first annotation that has one; rows
    with no (or an empty) label are dropped."""
    first = F.get(F.filter("annotations", lambda a: a["clause_type"].isNotNull()), 0)["clause_type"]
    return df.select("doc_id", "text", first.alias("label")).filter(
        F.col("label").isNotNull() & (F.col("label") != ""))


def prepare_summarization(df: DataFrame) -> DataFrame:
    """D3: all annotation summaries joined by a space."""
    sums = F.transform(F.filter("annotations", lambda a: a["summary"].isNotNull()), lambda a: a["summary"])
    return df.select("doc_id", "text", F.when(F.size(sums) > 0, F.array_join(sums, " ")).alias("summary")
                     ).filter(F.col("summary").isNotNull())


# --- exact rank cut ----------------------------------------------------------
def _frozen(df: DataFrame) -> DataFrame:
    """``df`` computed once: a split passes over its rows several times.  Staged as a
    table, so that a pass reads only the columns it takes."""
    if "void" in df.schema.simpleString():  # has no Parquet type
        ensure_checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    return staged(df, "split_rows")


def split_key(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def _cuts(keys: DataFrame, group_col: str | None, id_col: str, take: dict) -> dict:
    """For each group g with take[g] > 0, the (key, id) of the take[g]-th
    row in (key, id) order."""
    spark = keys.sparkSession
    ensure_checkpoint_dir(spark)
    parts = max(spark.sparkContext.defaultParallelism,
                int(spark.conf.get("spark.sql.shuffle.partitions")))
    g = [group_col] if group_col else []
    order = g + ["_k", id_col]
    rp = keys.repartitionByRange(parts, *order).withColumn("_pid", F.spark_partition_id())
    rp = rp.checkpoint(eager=True)  # freeze the range boundaries (reliable storage)
    counts = rp.groupBy("_pid", *g).count().collect()  # <= partitions + groups rows
    per_group: dict = {}
    for r in counts:
        per_group.setdefault(r[group_col] if group_col else None, []).append((r["_pid"], r["count"]))
    targets = []
    for grp, lst in per_group.items():
        k = take.get(grp, 0)
        if k <= 0:
            continue
        cum = 0
        for pid, c in sorted(lst):
            if cum + c >= k:
                targets.append((pid, grp, k - cum))
                break
            cum += c
    if not targets:
        return {}
    schema = "_pid int, _grp string, _rank long"
    tdf = F.broadcast(spark.createDataFrame([(p, None if grp is None else str(grp), r)
                                             for p, grp, r in targets], schema))
    cond = rp["_pid"] == tdf["_pid"]
    if group_col:
        cond = cond & (rp[group_col].cast("string") == tdf["_grp"])
    sel = rp.join(tdf, cond).drop(tdf["_pid"])
    w = Window.partitionBy("_pid", *g).orderBy("_k", id_col)
    sel = sel.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == F.col("_rank"))
    return {(r[group_col] if group_col else None): (r["_k"], r[id_col]) for r in sel.collect()}


def _le(cut_k: Column, cut_id: Column, id_col: str) -> Column:
    return (F.col("_k") < cut_k) | ((F.col("_k") == cut_k) & (F.col(id_col) <= cut_id))


def split_rows(df: DataFrame, test_size: float = 0.2, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """``df`` plus ``split`` in {train, test}; exactly
    ceil(test_size * n) rows are test, chosen by the seeded md5 key."""
    return _split_rows(_frozen(df.withColumn("_k", split_key(id_col, seed))), test_size, id_col)


def _split_rows(keyed: DataFrame, test_size: float, id_col: str) -> DataFrame:
    n_test = math.ceil(test_size * keyed.count())
    cut = _cuts(keyed.select("_k", id_col), None, id_col, {None: n_test}).get(None)
    if cut is None:
        return keyed.withColumn("split", F.lit("train")).drop("_k")
    is_test = _le(F.lit(cut[0]), F.lit(cut[1]), id_col)
    return keyed.withColumn("split", F.when(is_test, "test").otherwise("train")).drop("_k")


def split_stratified(df: DataFrame, label_col: str = "label", test_size: float = 0.2, seed: int = 42,
                     id_col: str = "doc_id") -> DataFrame:
    """Per label (any type; NULL is one of them), round(test_size *
    n_label) test rows by the seeded md5 key; plain D4 when there is a single
    label.

    The rows are staged once, numbered.  Their keys alone are range-partitioned by
    (label, key, id, number); a label's cut is the row whose place in its partition
    plus the label's rows in earlier partitions, which come from a table of counts
    by (label, partition), makes its number of test rows.  The split compares each
    row with its label's cut, so texts are not shuffled.  A label with a third of
    all rows spreads over partitions, no label list is collected, and the joins
    compare labels as they are, null-safely."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    keyed = _frozen(df.withColumns({"_k": split_key(id_col, seed), "_row": F.monotonically_increasing_id()}))
    if len(keyed.select(label_col).distinct().limit(2).collect()) <= 1:
        return _split_rows(keyed.drop("_row"), test_size, id_col)
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["_k", "_id", "_row"]
    keys = keyed.select(F.col(label_col).alias("_lab"), "_k", F.col(id_col).alias("_id"), "_row")
    keys = _frozen(keys.repartitionByRange(parts, "_lab", *order).withColumn("_pid", F.spark_partition_id()))  # freezes the range boundaries
    counts = keys.groupBy("_lab", "_pid").agg(F.count(F.lit(1)).alias("_n"))
    of_label = Window.partitionBy("_lab")
    before = F.coalesce(F.sum("_n").over(of_label.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    take = F.floor(F.lit(test_size) * F.sum("_n").over(of_label) + 0.5)
    counts = counts.select(F.col("_lab").alias("_of"), F.col("_pid").alias("_part"), "_n", (take - before).alias("_place"))
    counts = counts.filter((F.col("_place") > 0) & (F.col("_place") <= F.col("_n")))  # the partition with the label's cut
    same = (F.col("_pid") == F.col("_part")) & F.col("_lab").eqNullSafe(F.col("_of"))
    place = F.row_number().over(Window.partitionBy("_pid", "_lab").orderBy(*order))
    cuts = keys.join(counts, same).withColumn("_rn", place).filter(F.col("_rn") == F.col("_place"))
    # staged, so its size is known when the join with the rows is planned
    cuts = _frozen(cuts.select("_lab", F.struct(*order).alias("_cut")))
    is_test = F.struct(F.col("_k"), F.col(id_col).alias("_id"), F.col("_row")) <= F.col("_cut")
    return keyed.join(cuts, F.col(label_col).eqNullSafe(F.col("_lab")), "left").withColumn(
        "split", F.when(is_test, "test").otherwise("train")).select(*df.columns, "split")
