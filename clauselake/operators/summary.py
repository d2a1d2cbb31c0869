"""Summaries, key phrases and summary statistics (M1-M9).

M1, M2 and M5 rank inside one document: the sentence/token array is
sorted with ``array_sort`` in the task that read the document, so the
ranking needs no shuffle and no window over a skewed key.  M3 (TF-IDF) counts
terms across a document's sentences by runs of one sorted array of that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake import vocab as V
from clauselake.functions.arrays import empty_array, indices, let_, with_arrays
from clauselake.functions.text import (SEP, clean_summary, col_, date_mentions, is_section_header,
                                       lit_str_array, more_words_than, sentence_array, strip, word_count)
from clauselake.operators.boundary import BoundaryModel, sentences_of
from clauselake.operators.classify import document_type
from clauselake.operators.entities import party_mentions

SUMMARY_TYPE = ("struct<summary:string,original_length:int,summary_length:int,"
                "compression_ratio:double,document_type:string,status:string,"
                "fallback_summary:string>")


def _fix_punct(c: Column) -> Column:
    for a, b in ((" .", "."), (" ,", ","), ("..", "."), (".,", ",")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(0.0))


# --- terms of sentences --------------------------------------------------------
def _with_terms(df: DataFrame, sents: Column, entries: Column, term) -> DataFrame:
    """``df`` plus ``_low``, the lower-cased sentences, and ``_terms``, those
    ``entries`` whose ``term`` occurs in any: a sentence is asked for these only."""
    joined = let_(F.lower(F.array_join(sents, SEP)), lambda t: F.struct(t.alias("t"), F.split(t, SEP).alias("s")))
    d = with_arrays(df, _joined=joined)
    same = F.size("_joined.s") == F.size(sents)  # not if a sentence holds the separator
    return with_arrays(d, _low=F.when(same, F.col("_joined.s")).otherwise(F.transform(sents, F.lower)),
                       _terms=F.filter(entries, lambda x: F.contains(F.col("_joined.t"), term(x)))).drop("_joined")


# --- M1 ----------------------------------------------------------------------
def _m1_score(s: Column, i: Column, n: Column) -> Column:
    """position x length x content, in double arithmetic and in the same
    operation order as the reproduced code (so float ties match)."""
    pos = F.when(i < n * F.lit(0.1), F.lit(1.5)).when(i > n * F.lit(0.9), F.lit(1.3)).otherwise(F.lit(1.0))
    length = F.when(~more_words_than(s, 9), F.lit(1.0)).when(more_words_than(s, 30), F.lit(0.8)).otherwise(F.lit(1.2))
    hits = let_(F.get("_low", i), lambda low: F.filter("_terms", lambda t: F.contains(low, t)))
    content = F.lit(1.0) + F.aggregate(hits, F.lit(0.0), lambda a, _t: a + F.lit(0.1))
    return pos * length * content


def with_summary(df: DataFrame, text_col: str = "text", out: str = "summary",
                 sents_col: str | None = None) -> DataFrame:
    """M1 + M4 + M6 + M7 + M8: adds ``out`` (SUMMARY_TYPE struct) and keeps
    the kept-sentence array in ``_kept``.  ``sents_col`` may name an
    existing sentence array (G1) to reuse.

    Ranking: kept sentences (> 3 words) sorted by (-score, position); the
    top k = min(max(int(0.2 n), 3), 10) are put back in order of first
    occurrence of their text; ties keep rank order."""
    text = F.col(text_col)
    sents = F.col(sents_col) if sents_col else sentence_array(text)
    d = with_arrays(df, _kept=F.filter(sents, lambda s: more_words_than(s, 3)))
    kept = F.col("_kept")
    d = _with_terms(d, kept, lit_str_array(V.IMPORTANT_TERMS), lambda t: t)
    n = F.size(kept)
    k = F.least(F.greatest(F.floor(n * F.lit(0.2)).cast("int"), F.lit(3)), F.lit(10))
    ranked = F.sort_array(F.transform(kept, lambda s, i: F.struct(
        (-_m1_score(s, i, n)).alias("neg"), i.alias("i"), s.alias("s"))))
    top = F.slice(ranked, 1, k)
    ordered = F.sort_array(F.transform(top, lambda x, r: F.struct(
        F.array_position(kept, x["s"]).alias("first"), r.alias("r"), x["s"].alias("s"))))
    d = with_arrays(d, _stext=_fix_punct(F.array_join(F.transform(ordered, lambda x: x["s"]), " ")),
                    _orig=word_count(text), _dtype=document_type(text))
    stext, orig = F.col("_stext"), F.col("_orig")
    slen = word_count(stext)
    ratio = _ratio(slen, orig)
    d = with_arrays(d, _slen=slen, _ratio=ratio)
    slen, ratio = F.col("_slen"), F.col("_ratio")

    first = F.get(kept, 0)
    dates = date_mentions(text)
    ents = F.array_distinct(F.slice(party_mentions(F.substring(text, 1, 1000)), 1, 5))
    fallback = F.concat_ws(
        "\n",
        F.when(word_count(first) <= 15, F.concat(F.lit("Title: "), first)),
        F.when(F.size(dates) > 0, F.concat(F.lit("Dates mentioned: "),
                                           F.array_join(F.slice(dates, 1, 3), ", "))),
        F.when(F.size(ents) > 0, F.concat(F.lit("Key entities: "), F.array_join(ents, ", "))),
        F.concat(F.lit("Document length: "), orig.cast("string"), F.lit(" words")),
        F.concat(F.lit("Number of sentences: "), n.cast("string")),
    )
    fallback = F.when((slen < 10) | (ratio < 0.1), fallback)
    d = with_arrays(d, _fb=fallback)
    fb = F.col("_fb")
    head = F.concat(F.lit("This "), F.col("_dtype"), F.lit(" contains the following key points:\n\n"), stext)
    composed = F.when(fb.isNull(), head).otherwise(
        F.concat(head, F.lit("\n\nAdditional Information:\n"), fb))

    def summ(s, o, sl, r, t, st, f):
        return F.struct(s.alias("summary"), o.cast("int").alias("original_length"),
                        sl.cast("int").alias("summary_length"), r.cast("double").alias("compression_ratio"),
                        t.alias("document_type"), st.alias("status"), f.cast("string").alias("fallback_summary"))

    result = (
        F.when(text.isNull() | (strip(text) == ""),
               summ(F.lit(V.EMPTY_SUMMARY), F.lit(0), F.lit(0), F.lit(0.0), F.lit("empty document"),
                    F.lit("error"), F.lit(V.EMPTY_FALLBACK)))
        .when(n == 0,
              summ(F.lit(V.NO_SENTENCE_SUMMARY), orig, F.lit(0), F.lit(0.0), F.lit("document"),
                   F.lit("ok"), F.lit(V.NO_SENTENCE_FALLBACK)))
        .otherwise(summ(composed, orig, slen, ratio, F.col("_dtype"), F.lit("success"), fb))
    )
    d = d.withColumn(out, result)
    return d.drop("_low", "_terms", "_stext", "_orig", "_dtype", "_slen", "_ratio", "_fb")


def summarize(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", model: BoundaryModel | None = None) -> DataFrame:
    """M1 flat form: doc_id + the summary fields; ``model`` holds learned
    sentence boundaries."""
    d = df.select(id_col, text_col)
    if model is None:
        d = with_summary(d, text_col)
    else:
        d = with_summary(with_arrays(d, _sents=sentences_of(F.col(text_col), model)), text_col, sents_col="_sents")
    return d.select(id_col, "summary.*")


# --- M9 ----------------------------------------------------------------------
def summaries_array(summary) -> Column:
    """M9: [main summary, first two '.'-pieces joined by a space]."""
    s = col_(summary)
    short = strip(F.array_join(F.slice(F.split(s, r"\."), 1, 2), " "))
    return F.array(s, F.when(short != "", short).otherwise(s))


# --- M2 ----------------------------------------------------------------------
def _m2_score(s: Column, i: Column) -> Column:
    hits = let_(F.get("_low", i), lambda low: F.filter("_terms", lambda x: F.contains(low, x["t"])))
    base = F.aggregate(hits, F.lit(1.0), lambda a, x: a + x["w"])
    base = F.when(more_words_than(s, 30), base * F.lit(0.8)).otherwise(base)
    return let_(base, lambda b: F.when(is_section_header(s), b * F.lit(1.5)).otherwise(b))


def summarize_legal(df: DataFrame, max_sentences: int = 5, text_col: str = "text",
                    id_col: str = "doc_id", model: BoundaryModel | None = None) -> DataFrame:
    """M2: legal-weight extractive summary (top ``max_sentences`` by weight,
    back in document order), with word-count statistics and key terms."""
    d = with_arrays(df.select(id_col, text_col), _s=sentences_of(F.col(text_col), model))
    sents = F.col("_s")
    weights = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w).alias("w")) for t, w in V.LEGAL_WEIGHTS])
    d = _with_terms(d, sents, weights, lambda x: x["t"])
    ranked = F.sort_array(F.transform(sents, lambda s, i: F.struct(
        (-_m2_score(s, i)).alias("neg"), i.alias("i"), s.alias("s"))))
    top = F.slice(ranked, 1, max_sentences)
    ordered = F.sort_array(F.transform(top, lambda x, r: F.struct(
        F.array_position(sents, x["s"]).alias("first"), r.alias("r"), x["s"].alias("s"))))
    d = with_arrays(d, summary=F.array_join(F.transform(ordered, lambda x: x["s"]), " "),
                    original_length=word_count(F.col(text_col)))
    slen = word_count("summary")
    return d.select(
        id_col, "summary", "original_length", slen.alias("summary_length"),
        _ratio(slen, F.col("original_length")).alias("compression_ratio"),
        lit_str_array([t for t, _ in V.LEGAL_WEIGHTS]).alias("key_terms"))


# --- M4 ----------------------------------------------------------------------
def summary_stats(df: DataFrame, text_col: str = "text", summary_col: str = "summary") -> DataFrame:
    """M4: original/summary word counts and the safe compression ratio."""
    o, s = word_count(text_col), word_count(summary_col)
    return df.withColumn("original_length", o).withColumn("summary_length", s).withColumn(
        "compression_ratio", _ratio(F.col("summary_length"), F.col("original_length")))


# --- M5 ----------------------------------------------------------------------
def key_phrases(df: DataFrame, k: int = 10, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """M5: the ``k`` most frequent alphanumeric tokens that are not English
    or legal stop words; ties by first occurrence.  (doc_id, rank, phrase,
    freq)."""
    stop = list(V.ENGLISH_STOP_WORDS) + list(V.LEGAL_STOP_WORDS)
    toks = F.filter(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"([\p{L}\p{N}]+)"), 1),
                    lambda t: ~t.isin(*stop))
    d = with_arrays(df.select(id_col, text_col),
                    _z=F.array_sort(F.transform(toks, lambda t, i: F.struct(t.alias("w"), i.alias("p")))))
    z = F.col("_z")
    m = F.size(z)
    starts = F.filter(F.sequence(F.lit(0), m - 1),
                      lambda i: (i == 0) | (F.get(z, i)["w"] != F.get(z, i - 1)["w"]))
    d = with_arrays(d, _st=F.when(m > 0, starts).otherwise(F.expr("CAST(array() AS array<int>)")))
    st = F.col("_st")
    entries = F.transform(st, lambda s0, j: F.struct(
        (-(F.when(j + 1 < F.size(st), F.get(st, j + 1)).otherwise(m) - s0)).alias("neg"),
        F.get(z, s0)["p"].alias("first"), F.get(z, s0)["w"].alias("w")))
    top = F.slice(F.array_sort(entries), 1, k)
    d = d.select(id_col, F.posexplode(top).alias("rank", "e"))
    return d.select(id_col, (F.col("rank") + 1).alias("rank"), F.col("e.w").alias("phrase"),
                    (-F.col("e.neg")).cast("int").alias("freq"))


# --- M3 ----------------------------------------------------------------------
def summarize_tfidf(df: DataFrame, max_length: int = 150, max_features: int = 10_000,
                    text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """M3: TF-IDF extractive summary over the sentences of each document.

    Documents with at most ``max_length`` sentences return their cleaned
    text (ratio 1.0).  Longer ones are scored: terms are ``\\w\\w+`` tokens
    minus stop words plus adjacent bigrams; idf = ln((1+n)/(1+df)) + 1;
    the sentence score is the sum of its L2-normalised tf-idf row; the top
    ``max_length`` (ties: later sentence first) are joined in document
    order.  Lengths are in sentences.

    Plan: everything stays in the document's row.  Its (term, sentence) pairs are
    sorted once; runs of equal pairs give tf, runs of equal terms df and totals;
    weights, sorted by sentence, give the norms.  No shuffle, one scan.
    """
    base = with_arrays(df.select(id_col, text_col), _clean=clean_summary(F.col(text_col)))
    base = with_arrays(base, _sents=sentence_array(F.col("_clean")))
    n = F.size("_sents")
    empty = F.col(text_col).isNull() | (strip(F.col(text_col)) == "")
    stop = list(V.ENGLISH_STOP_WORDS)

    def terms(t: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - 1, F.lit(1))), lambda i: F.concat(F.get(t, i - 1), F.lit(" "), F.get(t, i)))
        return F.concat(t, F.when(F.size(t) > 1, pairs).otherwise(empty_array("string")))

    def entries(s: Column, i: Column) -> Column:
        words = F.filter(F.regexp_extract_all(F.lower(s), F.lit(r"([\p{L}\p{N}_]{2,})"), 1), lambda t: ~t.isin(*stop))
        return F.transform(let_(words, terms), lambda t: F.struct(t.alias("t"), i.alias("p")))

    def run_starts(z: Column, key) -> Column:
        """Places where a sorted array's key changes."""
        return F.filter(indices(z), lambda i: (i == 0) | (key(F.get(z, i)) != key(F.get(z, i - 1))))

    def until(starts: Column, j: Column, end: Column) -> Column:
        return F.coalesce(F.get(starts, j + 1), end)

    long_ = ~F.coalesce(empty, F.lit(True)) & (n > max_length)
    d = with_arrays(base, _z=F.when(long_, F.array_sort(F.flatten(F.transform("_sents", entries)))).otherwise(empty_array("struct<t:string,p:int>")))
    z = F.col("_z")
    d = with_arrays(d, _ps=run_starts(z, lambda x: x))
    ps = F.col("_ps")
    d = with_arrays(d, _ts=F.filter(indices(ps), lambda j: (j == 0) | (F.get(z, F.get(ps, j))["t"] != F.get(z, F.get(ps, j - 1))["t"])))
    ts = F.col("_ts")
    known = F.transform(ts, lambda first, k: let_(until(ts, k, F.size(ps)), lambda last: F.struct(
        (F.get(ps, first) - F.coalesce(F.get(ps, last), F.size(z))).alias("neg"), F.get(z, F.get(ps, first))["t"].alias("t"),
        first.alias("first"), (last - first).alias("df"))))
    # the vocabulary: the most frequent terms, ties by code point
    d = with_arrays(d, _vocab=F.when(F.size(ts) > max_features, F.slice(F.array_sort(known), 1, max_features)).otherwise(known))

    def weighted(v: Column) -> Column:
        idf = F.log((n + 1) / (v["df"] + 1)) + 1
        return let_(idf, lambda w: F.transform(F.sequence(v["first"], v["first"] + v["df"] - 1), lambda j: F.struct(
            F.get(z, F.get(ps, j))["p"].alias("p"), ((until(ps, j, F.size(z)) - F.get(ps, j)) * w).alias("w"))))

    d = with_arrays(d, _w=F.array_sort(F.flatten(F.transform("_vocab", weighted))))
    w = F.col("_w")
    d = with_arrays(d, _ws=run_starts(w, lambda x: x["p"]))
    ws = F.col("_ws")

    def score(a: Column, j: Column) -> Column:
        own = F.slice(w, a + 1, until(ws, j, F.size(w)) - a)
        sums = F.aggregate(own, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), lambda acc, x: F.struct(
            (acc["s"] + x["w"]).alias("s"), (acc["q"] + x["w"] * x["w"]).alias("q")))
        return let_(sums, lambda x: F.struct((-(x["s"] / F.sqrt(x["q"]))).alias("neg"), (-F.get(w, a)["p"]).alias("np")))

    scored = F.transform(ws, score)
    bare = F.array_except(indices(F.col("_sents")), F.transform(ws, lambda a: F.get(w, a)["p"]))  # sentences without a term
    ranked = F.concat(scored, F.transform(bare, lambda p: F.struct(F.lit(0.0).alias("neg"), (-p).alias("np"))))
    chosen = F.array_sort(F.transform(F.slice(F.array_sort(ranked), 1, max_length), lambda x: -x["np"]))
    d = with_arrays(d, _sel=F.when(long_, chosen).otherwise(empty_array("int")))
    picked = F.array_join(F.transform("_sel", lambda p: F.get(F.col("_sents"), p)), " ")
    kept = F.size("_sel")
    return d.select(
        id_col,
        F.when(empty, F.lit("")).when(long_, picked).otherwise(F.col("_clean")).alias("summary"),
        F.when(empty, 0).otherwise(n).cast("int").alias("original_length"),
        F.when(empty, 0).when(long_, kept).otherwise(n).cast("int").alias("summary_length"),
        F.when(empty, 0.0).when(long_, kept / n).otherwise(1.0).cast("double").alias("compression_ratio"))
