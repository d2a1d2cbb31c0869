"""Mixing sources to target weights, in DataFrame functions only.

Sizes are added up by source.  Sources share a budget (a multiple of all sizes)
by weight; a target stops at ``most`` times its source's size, and the excess is
reshared by weight until none is above.  That fills sources up to one common
level of target per weight: taken by rising (cap / weight), the first sources
are capped, and the level is what is left over the weight that is left.  A
source's repetition rate is target / size; each document is taken floor(rate)
times, plus once more if a hash of its id and the seed, as a number in [0, 1),
is below the fraction.  The hash makes reruns agree.

Only totals of sources are ordered by windows, a row for each source; documents
are counted by a partial aggregate (a source with a third of all rows meets as
one partial sum from each task) and joined back to their source's rate, which
adaptive execution broadcasts if it is small and splits if it is skewed.

Cases: a null or empty text has size 0 and takes nothing; a null source is a
source of its own, last in order; a null id hashes as the empty string; an
empty source has target 0; repeated rows are taken alike; columns beside the
three named ones are kept by ``emit`` (working columns carry the prefix
``_mix_``); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST = 2.0
SEED = "mix-1"
#: Hexadecimal digits of the hash that make a number below 1.
_DIGITS = 13


def n_words(text: Column) -> Column:
    """Number of maximal runs outside ``[\\x20\\x09-\\x0D]``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def chance(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) that the id and the seed fix."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("double") / F.lit(float(16**_DIGITS))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """``_mix_source, source_size, target`` from one row for each source."""
    in_order = Window.orderBy(F.col("_mix_source").asc_nulls_last())
    place = (F.row_number().over(in_order) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int"))
    by_level = Window.orderBy("_mix_level", "_mix_weight", F.col("_mix_source").asc_nulls_last())
    below = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    size = F.col("source_size").cast("double")
    s = sizes.withColumn("_mix_weight", weight).withColumn("_mix_level", F.lit(most) * size / F.col("_mix_weight"))
    # what is left per weight if exactly the sources of lower levels are capped
    total, heft = F.sum("source_size").over(everything), F.sum("_mix_weight").over(everything)
    gone, spent = (F.coalesce(F.sum(c).over(below), F.lit(0)) for c in ("_mix_weight", "source_size"))
    s = s.withColumn("_mix_share", (F.lit(budget) * total - F.lit(most) * spent) / (heft - gone))
    open_ = F.col("_mix_share") <= F.col("_mix_level")
    s = s.withColumn("_mix_rank", F.when(open_, F.row_number().over(by_level)))
    level = F.min(F.when(open_, F.struct("_mix_rank", "_mix_share"))).over(everything)["_mix_share"]
    return s.select("_mix_source", "source_size", F.least(F.lit(most) * size, F.coalesce(level * F.col("_mix_weight"), F.lit(most) * size)).alias("target"))


def rates(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: str = SEED, **share) -> DataFrame:
    """The input's rows with ``_mix_size, _mix_total, _mix_target, _mix_copies``."""
    name = lambda c: F.col(f"`{c}`")
    sized = documents.withColumns({"_mix_size": n_words(name(text)), "_mix_source": name(source).cast("string")})
    of = targets(sized.groupBy("_mix_source").agg(F.sum("_mix_size").alias("source_size")), **share)
    of = of.select(F.col("_mix_source").alias("_mix_key"), F.col("source_size").alias("_mix_total"), F.col("target").alias("_mix_target"))
    rate = F.when(F.col("_mix_total") > 0, F.col("_mix_target") / F.col("_mix_total")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    copies = whole + F.when(chance(name(doc_id), seed) < rate - whole, 1).otherwise(0)
    return sized.join(of, F.col("_mix_source").eqNullSafe(F.col("_mix_key"))).withColumn("_mix_copies", copies.cast("long"))


def taken(documents: DataFrame, seed: str = SEED, **share) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    columns = documents.select("doc_id", "text", "source")
    return rates(columns, seed=seed, **share).select(
        F.col("doc_id").cast("long"), F.col("_mix_size").alias("size"), F.col("_mix_total").alias("source_size"),
        F.col("_mix_target").alias("target"), (F.col("_mix_size") * F.col("_mix_copies")).alias("taken"))


def emit(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: str = SEED, **share) -> DataFrame:
    """The mix itself: each document as often as it is taken."""
    r = rates(documents, text, doc_id, source, seed, **share)
    copies = F.when(F.col("_mix_copies") > 0, F.sequence(F.lit(1).cast("long"), F.col("_mix_copies"))).otherwise(F.array().cast("array<bigint>"))
    return r.withColumn("_mix_copy", F.explode(copies)).select(*(F.col(f"`{c}`") for c in documents.columns))


#: The same computation in DuckDB SQL.
ORACLE_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')), 0)::BIGINT AS size FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source),
leveled AS (SELECT *, {MOST} * source_size::DOUBLE / weight AS level FROM sources),
shared AS (
  SELECT *, row_number() OVER w AS place,
    (CAST({BUDGET} AS DOUBLE) * (SELECT sum(source_size) FROM sources)::DOUBLE
      - CAST({MOST} AS DOUBLE) * coalesce(sum(source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / ((SELECT sum(weight) FROM sources) - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS share
  FROM leveled WINDOW w AS (ORDER BY level, weight, source ASC NULLS LAST)),
targets AS (
  SELECT source, source_size, least({MOST} * source_size::DOUBLE,
    coalesce((SELECT arg_min(share, place) FROM shared WHERE share <= level) * weight, {MOST} * source_size::DOUBLE)) AS target
  FROM shared),
rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
  (size * (floor(rate)::BIGINT + CASE WHEN ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, {_DIGITS}))::BIGINT::DOUBLE / {16**_DIGITS}::DOUBLE
     < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated"""
