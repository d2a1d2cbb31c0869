"""Learned sentence boundaries (G1 with abbreviations).

Which periods end a sentence is learned from the corpus itself, without labels,
after Kiss and Strunk (2006): a type (lower-cased token without its final
period) is an abbreviation if it stands before a period far more often than
chance has it, scaled by its length, its inner periods and how often it stands
without one; a pair of a type with a period and the number or small word behind
it is a collocation by its log-likelihood ratio ("No. 7"); a type is an opener
if it is capitalised behind [.!?] and otherwise only seen in small letters.

The counts are one aggregation over the tokens of the corpus, reduced in each
task before the shuffle.  What a splitter needs is three bounded sets
(``BoundaryModel``), which travel as literals of its plan; splitting is a
per-row expression, like G1.

A period and the next piece of text stay together if the type before it is an
abbreviation and no capitalised opener follows, if both are a collocation, or if
it is an initial (one capital letter) before a capitalised type that is no
opener.  A blank line between them always parts them, and so do ``!`` and ``?``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake import vocab as V
from clauselake.functions.arrays import let_, with_arrays
from clauselake.functions.text import SEP, col_, sentence_array, strip
from clauselake.session import work_dir

#: A token: from the first letter or digit of a run without white space to its
#: last letter, digit or [.!?].
TOKEN = rf"[\p{{L}}\p{{N}}](?:[^{V.WS_CHARS}]*[\p{{L}}\p{{N}}.!?])?"
NUMBER = "#"
#: Published thresholds of the abbreviation score and the collocation ratio.
ABBREVIATION_SCORE, COLLOCATION_RATIO = 0.3, 7.88
#: Share of a true abbreviation's occurrences that have their period.
WITH_PERIOD = 0.99
#: Longest abbreviation, and the characters looked at on each side of a period.
LONGEST, REACH = 20, 64
#: Bounds of the model: best scores, ratios, and most frequent openers.
MOST = 10_000

LEARNED = "kind string, type string, next string, n long, score double"
_LAST = rf"[\p{{L}}\p{{N}}][^{V.WS_CHARS}]*\z"
_FIRST = rf"^{V.WS}*[^{V.WS_CHARS}\p{{L}}\p{{N}}]*({TOKEN})"
_BLANK_LINE = r"^[ \t\r\f\x0b]*\n[ \t\r\f\x0b]*\n"


# --- types -------------------------------------------------------------------
def _ended(token: Column) -> Column:
    return token.endswith(".") | token.endswith("!") | token.endswith("?")


def _type(token: Column) -> Column:
    """Lower-cased token without one final [.!?]; ``#`` for what starts with an
    ASCII digit."""
    bare = F.when(_ended(token), F.substring(token, 1, F.length(token) - 1)).otherwise(token)
    return F.when(F.substring(token, 1, 1).between("0", "9"), F.lit(NUMBER)).otherwise(F.lower(bare))


def _upper(token: Column) -> Column:
    return token.rlike(r"^\p{Lu}")


def _small(token: Column) -> Column:
    """Starts with a small letter or an ASCII digit."""
    return token.rlike(r"^[\p{Ll}0-9]")


# --- counts ------------------------------------------------------------------
def type_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Counts by (type, next): tokens with a period, without one, in small
    letters, capitalised inside a sentence, and capitalised behind [.!?].
    ``next`` is the type behind a period where that is a number or in small
    letters, else NULL."""
    d = with_arrays(df.select(F.col(text_col).alias("_text")), _t=F.regexp_extract_all("_text", F.lit(TOKEN), 0))
    toks = F.col("_t")
    # each token beside its neighbours, as rows: their expressions run as generated code
    before = F.slice(F.concat(F.array(F.lit(None).cast("string")), toks), 1, F.size(toks))
    near = d.select(F.inline(F.arrays_zip(toks.alias("t"), before.alias("behind"), F.slice(toks, 2, F.size(toks)).alias("ahead"))))
    t, behind, ahead = F.col("t"), F.col("behind"), F.col("ahead")
    period, up, ended = t.endswith("."), _upper(t), F.coalesce(_ended(behind), F.lit(False))
    rows = near.select(_type(t).alias("type"), F.when(period & _small(ahead), _type(ahead)).alias("next"), period.alias("period"),
                       t.rlike(r"^\p{Ll}").alias("small"), (up & ~ended & behind.isNotNull()).alias("inside"), (up & ended).alias("behind"))
    return rows.groupBy("type", "next").agg(
        F.count_if("period").alias("n_period"), F.count_if(~F.col("period")).alias("n_plain"), F.count_if("small").alias("n_small"),
        F.count_if("inside").alias("n_inside"), F.count_if("behind").alias("n_behind"))


def _fit(k: Column, n: Column, p: Column) -> Column:
    """Log-likelihood of k hits in n trials of chance p (0 log 0 is 0)."""
    return (F.when(k > 0, k * F.log(p)).otherwise(F.lit(0.0)) + F.when(n > k, (n - k) * F.log(F.lit(1.0) - p)).otherwise(F.lit(0.0)))


def abbreviation_score(type_: Column, n_period: Column, n_plain: Column, chance: float) -> Column:
    """Score of a type that ``n_period`` times has its period and ``n_plain`` times
    hasn't, where a token has one by ``chance``."""
    n = n_period + n_plain
    ratio = F.lit(-2.0) * (_fit(n_period, n, F.lit(chance)) - _fit(n_period, n, F.lit(WITH_PERIOD)))
    letters = F.length(F.replace(type_, F.lit("."), F.lit("")))
    return ratio * F.exp(-letters.cast("double")) * (F.length(type_) - letters + 1) * F.pow(letters.cast("double"), -n_plain.cast("double"))


def collocation_ratio(both: Column, first: Column, second: Column, total: int) -> Column:
    """Log-likelihood ratio of ``second`` following ``first`` (Dunning 1993)."""
    n = F.lit(total)
    p = second / n
    apart, rest = second - both, n - first
    return F.lit(2.0) * (_fit(both, first, both / first) + _fit(apart, rest, apart / rest) - _fit(both, first, p) - _fit(apart, rest, p))


def learn_boundaries(df: DataFrame, text_col: str = "text", most: int = MOST) -> DataFrame:
    """The learned rows (``LEARNED``): kinds ``abbreviation``, ``collocation`` and
    ``opener``, at most ``most`` of each; ``n`` is how often it was seen."""
    spark = df.sparkSession
    path = work_dir(spark, "boundary_counts")
    type_counts(df, text_col).write.parquet(path)
    counts = spark.read.parquet(path)
    types = counts.groupBy("type").agg(*(F.sum(c).alias(c) for c in ("n_period", "n_plain", "n_small", "n_inside", "n_behind")))
    periods, total = types.agg(F.sum("n_period"), F.sum(F.col("n_period") + F.col("n_plain"))).first()
    if not total or not periods or periods == total:
        return spark.createDataFrame([], LEARNED)
    none = F.lit(None).cast("string").alias("next")
    score = abbreviation_score(F.col("type"), F.col("n_period"), F.col("n_plain"), periods / total)
    abbreviations = types.filter((F.col("n_period") > 0) & (F.length("type") <= LONGEST) & F.col("type").rlike(r"\p{L}")).select(
        F.lit("abbreviation").alias("kind"), "type", none, F.col("n_period").alias("n"), score.alias("score")).filter(
        F.col("score") >= ABBREVIATION_SCORE)
    of = types.select("type", (F.col("n_period") + F.col("n_plain")).alias("_n"))
    pairs = counts.filter(F.col("next").isNotNull() & (F.col("n_period") > 1) & F.col("type").rlike(r"\p{L}")).select("type", "next", F.col("n_period").alias("n"))
    pairs = pairs.join(of.withColumnRenamed("_n", "_first"), "type").join(
        of.select(F.col("type").alias("next"), F.col("_n").alias("_second")), "next")
    ratio = collocation_ratio(F.col("n"), F.col("_first"), F.col("_second"), total)
    pairs = pairs.filter(F.col("n") * total > F.col("_first") * F.col("_second")).select(
        F.lit("collocation").alias("kind"), "type", "next", "n", ratio.alias("score")).filter(F.col("score") >= COLLOCATION_RATIO)
    openers = types.filter((F.col("n_small") > 0) & (F.col("n_inside") == 0) & (F.col("n_behind") > 0)).select(
        F.lit("opener").alias("kind"), "type", none, F.col("n_behind").alias("n"), F.col("n_behind").cast("double").alias("score"))

    def best(rows: DataFrame) -> DataFrame:
        return rows.orderBy(F.desc("score"), "type", "next").limit(most)

    return best(abbreviations).unionAll(best(pairs)).unionAll(best(openers))


# --- splitting ---------------------------------------------------------------
@dataclass(frozen=True)
class BoundaryModel:
    """What a splitter consults; ``collocations`` are "type next" strings."""

    abbreviations: frozenset
    collocations: frozenset
    openers: frozenset

    @classmethod
    def of(cls, learned: DataFrame) -> BoundaryModel:
        """From learned rows (a bounded table, see ``learn_boundaries``)."""
        rows = learned.select("kind", "type", "next").collect()
        pick = lambda kind: frozenset(r.type if r.next is None else f"{r.type} {r.next}" for r in rows if r.kind == kind)
        return cls(pick("abbreviation"), pick("collocation"), pick("opener"))


def save_boundaries(learned: DataFrame, path: str) -> None:
    learned.write.mode("overwrite").parquet(path)


def load_boundaries(spark, path: str) -> BoundaryModel:
    return BoundaryModel.of(spark.read.parquet(path))


def _in(c: Column, values: frozenset) -> Column:
    return c.isin(*sorted(values)) if values else F.lit(False)


def _stays(piece: Column, after: Column, model: BoundaryModel) -> Column:
    """Whether what follows a piece's final period belongs to its sentence."""
    def decide(v: Column) -> Column:
        def types(w: Column) -> Column:
            last, first, t, n = v["last"], v["first"], w["t"], w["n"]
            up = _upper(first)
            open_ = up & _in(n, model.openers)
            initial = last.rlike(r"^\p{Lu}\.\z") & up
            return _in(F.concat(t, F.lit(" "), n), model.collocations) & _small(first) | (
                _in(t, model.abbreviations) | initial) & ~open_
        return let_(F.struct(_type(v["last"]).alias("t"), _type(v["first"]).alias("n")), types)

    ends = let_(F.struct(F.regexp_extract(F.right(piece, F.lit(REACH)), _LAST, 0).alias("last"),
                         F.regexp_extract(F.left(after, F.lit(REACH)), _FIRST, 1).alias("first")), decide)
    return F.when(piece.endswith(".") & ~after.rlike(_BLANK_LINE), ends).otherwise(F.lit(False))


def sentences_of(text, model: BoundaryModel | None = None) -> Column:
    """G1 by the bare rule, or with a learned model where one is given."""
    return sentence_array(text) if model is None else learned_sentence_array(text, model)


def learned_sentence_array(text, model: BoundaryModel) -> Column:
    """G1 with a learned model: candidate breaks as in G1; pieces that belong
    together keep the white space between them."""
    marked = F.regexp_replace(col_(text), f"([.!?])({V.WS}+)", "$1" + SEP + "$2")

    def join(pieces: Column) -> Column:
        last = F.size(pieces) - 1
        parted = F.transform(pieces, lambda p, i: F.when((i < last) & ~_stays(p, F.get(pieces, i + 1), model), F.concat(p, F.lit(SEP))).otherwise(p))
        return F.split(F.array_join(parted, ""), SEP)

    return F.filter(F.transform(let_(F.split(marked, SEP), join), lambda s: strip(s)), lambda s: s != "")
