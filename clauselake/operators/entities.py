"""Entity extraction.

Per-document entity lists are arrays of ``ENTITY`` structs built with
built-in functions; nothing leaves the task that read the document.  The
long table (one row per mention) is an ``inline`` of that array.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase, digits

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake import vocab as V
from clauselake.functions.arrays import by_name, empty_array, let_, with_arrays
from clauselake.functions.text import col_, cut_context, lit_str_array, pieces_of, sentence_array, word_tokens

ENTITY = ("struct<source:string,ord:int,text:string,label:string,confidence:double,"
          "context:string,start:int,end:int>")


def _entity(source, ord_, text, label, conf, context, start=None, end=None) -> Column:
    return F.struct(
        F.lit(source).alias("source"), ord_.cast("int").alias("ord"), text.alias("text"),
        label.alias("label"), conf.cast("double").alias("confidence"), context.alias("context"),
        (start if start is not None else F.lit(None)).cast("int").alias("start"),
        (end if end is not None else F.lit(None)).cast("int").alias("end"))


# --- regex spans -------------------------------------------------------------
SPAN_BLOCK = 256  # block size of the two-level prefix sum in regex_spans
MARK = "\u0002"  # parts gaps and matches in regex_spans


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0), lambda a, x: a + x)


def prefix_starts(lengths: Column, block: int = SPAN_BLOCK) -> Column:
    """Exclusive prefix sums of an int array, in O(k * block + (k/block)^2)
    instead of the O(k^2) of summing every prefix: block totals first, then
    the totals of earlier blocks plus the sum inside the element's block."""
    def with_lengths(ln):
        k = F.size(ln)
        nb = F.ceil(k / F.lit(block)).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(nb - 1, F.lit(0))),
                             lambda b: _sum(F.slice(ln, b * block + 1, block)))

        def with_blocks(bs):
            before = F.transform(F.sequence(F.lit(0), F.greatest(nb - 1, F.lit(0))),
                                 lambda b: F.when(b > 0, _sum(F.slice(bs, 1, b))).otherwise(F.lit(0)))

            def with_before(bp):
                return F.transform(ln, lambda _x, i: F.get(bp, (i / block).cast("int")) + F.when(
                    i % block > 0, _sum(F.slice(ln, (i / block).cast("int") * block + 1, i % block))
                ).otherwise(F.lit(0)))
            return let_(before, with_before)
        return F.when(k > 0, let_(blocks, with_blocks)).otherwise(F.expr("CAST(array() AS array<int>)"))
    return let_(lengths, with_lengths)


def regex_spans(text, pattern: str) -> Column:
    """All non-overlapping matches of ``pattern`` as struct(text, start, end)
    (0-based, end exclusive), in text order.

    Offsets: one scan puts a mark before and behind each match, so the marked text
    falls into gaps and matches in turns; the start of match i is the length of all
    gaps and matches before it plus its own gap (a blocked prefix sum, see
    ``prefix_starts``).  A text that holds the mark itself is scanned twice instead
    (gaps, matches) by one regex, which goes on where its last match ended."""
    text = col_(text)
    step = F.lit(rf"\G((?s:.*?))({pattern})")

    def in_turns(pieces):
        n = F.shiftright(F.size(pieces), 1)
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
            F.get(pieces, 2 * i).alias("g"), F.get(pieces, 2 * i + 1).alias("m")))).otherwise(F.expr("CAST(array() AS array<struct<g:string,m:string>>)"))

    marked = let_(F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK), in_turns)
    scanned = F.arrays_zip(F.regexp_extract_all(text, step, 1).alias("g"), F.regexp_extract_all(text, step, 2).alias("m"))
    pairs = F.when(text.isNull(), F.lit(None)).when(F.contains(text, F.lit(MARK)), scanned).otherwise(marked)

    def with_pairs(pr):
        lens = F.transform(pr, lambda x: F.length(x["g"]) + F.length(x["m"]))
        starts = prefix_starts(lens)
        return F.zip_with(pr, starts, lambda x, st: let_(st + F.length(x["g"]), lambda at: F.struct(
            x["m"].alias("text"), at.alias("start"), (at + F.length(x["m"])).alias("end"))))
    return let_(pairs, with_pairs)


def _alternation(patterns) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def _quick(rules) -> str:
    """The alternation of rules for a search.  Of the fixed rules' words none is
    given back (no space can follow inside one), only the characters that a match
    can start with are tried, and ranges are written out (Java looks single
    characters up in a table, ranges one after the other)."""
    alternation = _alternation(p for _, p in rules)
    if not set(rules) <= set(V.PATTERN_ENTITY_RULES):
        return alternation
    quick = "(?=[A-Z0-9$])(?:" + alternation.replace("[A-Za-z0-9#&-]*", "[A-Za-z0-9#&-]*+") + ")"
    for span, characters in (("A-Z", ascii_uppercase), ("a-z", ascii_lowercase), ("0-9", digits)):
        quick = quick.replace(span, characters)
    return quick


# --- E1 ----------------------------------------------------------------------
def pattern_entity_array(text, rules=V.PATTERN_ENTITY_RULES, confidence: float = 0.9,
                         source: str = "ner") -> Column:
    """E1 (re-aimed statistical NER): DATE / AMOUNT / PARTY patterns, in text
    order, with spans and a +-50 character context.  The label is that of
    the first rule whose pattern matches the mention as a whole."""
    text = col_(text)
    spans = regex_spans(text, _quick(rules))

    def label(m: Column) -> Column:
        out = F.lit(None).cast("string")
        for lab, p in reversed(rules):
            out = F.when(m.rlike(f"^(?:{p})$"), F.lit(lab)).otherwise(out)
        return out

    return let_(pieces_of(text), lambda ps: F.transform(spans, lambda s, i: _entity(
        source, i, s["text"], label(s["text"]), F.lit(confidence),
        cut_context(ps, s["start"], s["end"], 50), s["start"], s["end"])))


def party_mentions(text) -> Column:
    """PARTY mention texts in text order (the analyser's 'key entities')."""
    rules = [r for r in V.PATTERN_ENTITY_RULES if r[0] == "PARTY"]
    return F.regexp_extract_all(col_(text), F.lit(_quick(rules)), 0)


# --- E2 / E3 -----------------------------------------------------------------
def gazetteer_array(text, terms, context: str, source: str, confidence: float = 0.8) -> Column:
    """One entity per term whose lower-case form occurs in the
    lower-cased text, in list order."""
    table = F.array(*[F.struct(F.lit(i).alias("o"), F.lit(t).alias("t"), F.lit(t.lower()).alias("lt"),
                               F.lit(lab).alias("l"))
                      for i, (t, lab) in enumerate(terms)])

    def body(low):
        hits = F.filter(table, lambda x: F.contains(low, x["lt"]))
        return F.transform(hits, lambda x: _entity(source, x["o"], x["t"], x["l"], F.lit(confidence),
                                                   F.lit(context)))
    return let_(F.lower(col_(text)), body)


def term_entities(df: DataFrame, terms: DataFrame, context: str, source: str, confidence: float = 0.8, text_col: str = "text",
                  id_col: str = "doc_id", broadcast_bytes: int | None = None) -> DataFrame:
    """E2/E3 with the term list as a table (ord, term, label) of any size: long
    form, one row for each document and term whose lower-case form occurs in the
    lower-cased text.  Terms are found through an index of their rarest character
    gram, not by trying each on each text; empty terms are dropped."""
    from clauselake.operators import gram_index

    size = gram_index.BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    texts = df.select(F.col(id_col), F.col(text_col).alias("_text"))
    listed = terms.select(F.col("ord").cast("int").alias("ord"), F.col("term").alias("_term"), F.col("label").alias("label"))
    hits = gram_index.occurrences(texts, listed, (id_col,), "_text", "_term", broadcast_bytes=size)
    none = F.lit(None).cast("int")
    return hits.select(id_col, F.lit(source).alias("source"), "ord", F.col("_term").alias("text"), "label", F.lit(confidence).alias("confidence"),
                       F.lit(context).alias("context"), none.alias("start"), none.alias("end"))


def structure_entity_array(text) -> Column:
    return gazetteer_array(text, V.STRUCTURE_TERMS, V.STRUCTURE_CONTEXT, "structure")


def format_entity_array(text) -> Column:
    return gazetteer_array(text, V.FORMAT_TERMS, V.FORMAT_CONTEXT, "format")


# --- E4 ----------------------------------------------------------------------
def legal_term_regex() -> str:
    alts = "|".join(t.replace(" ", f"{V.WS}+") for t in V.LEGAL_TERMS)
    heads = "".join(sorted({t[0] for t in V.LEGAL_TERMS}))  # only where a term can start
    return rf"(?iu)(?=[{heads}])\b(?:{alts})\b"


def _word_confidence(mention: Column) -> Column:
    """Confidence of the rule NER: min(0.5 + 0.1 * words, 0.9)."""
    return F.least(F.lit(0.5) + F.size(F.split(mention, f"{V.WS}+")) * F.lit(0.1), F.lit(0.9))


def legal_term_array(text, existing: Column | None = None) -> Column:
    """Legal-term ruler, label LEGAL_TERM, confidence
    min(0.5 + 0.1 * words, 0.9).  Mentions that overlap an ``existing``
    entity span are dropped (the earlier-found entity is kept)."""
    text = col_(text)
    spans = F.transform(regex_spans(text, legal_term_regex()), lambda s, i: F.struct(s["text"].alias("text"), s["start"].alias("start"), s["end"].alias("end"), i.alias("i")))
    if existing is not None:
        spans = F.filter(spans, lambda x: ~_overlaps(existing, x))
    # contexts are cut for what stays
    return let_(pieces_of(text), lambda ps: F.transform(spans, lambda s: _entity(
        "legal", s["i"], s["text"], F.lit("LEGAL_TERM"),
        _word_confidence(s["text"]),
        cut_context(ps, s["start"], s["end"], 50), s["start"], s["end"])))


def _overlaps(spans: Column, x: Column) -> Column:
    """Whether a span overlaps one of ``spans``, which are in text order and do not
    overlap each other: the last one that starts before ``x`` ends, found by
    halving, is the only one that can."""
    n = F.size(spans)
    halvings = F.sequence(F.lit(1), F.ceil(F.log2(n + 1)).cast("int"))
    before = F.aggregate(halvings, F.struct(F.lit(0).alias("lo"), n.alias("hi")), lambda r, _: let_(
        F.shiftright(r["lo"] + r["hi"], 1), lambda mid: F.when((r["lo"] < r["hi"]) & (F.get(spans, mid)["start"] < x["end"]), F.struct(
            (mid + 1).alias("lo"), r["hi"].alias("hi"))).otherwise(F.struct(r["lo"].alias("lo"), F.least(mid, r["hi"]).alias("hi")))))["lo"]
    return F.when(n > 0, F.coalesce(F.get(spans, before - 1)["end"] > x["start"], F.lit(False))).otherwise(F.lit(False))


# --- E5 ----------------------------------------------------------------------
def cue_entity_array(first_sentences: Column) -> Column:
    """E5: in each of the first five sentences, an 'Introduction' entity when
    a token is an intro cue and a 'Conclusion' entity when a token is a
    conclusion cue (both may fire), context = the sentence."""
    intro = lit_str_array(V.INTRO_CUES)
    concl = lit_str_array(V.CONCLUSION_CUES)
    empty = empty_array(ENTITY)

    def per_sentence(s: Column, i: Column) -> Column:
        toks = word_tokens(s)
        a = F.when(F.arrays_overlap(toks, intro), F.array(_entity(
            "cue", i * 2, F.lit("Introduction"), F.lit("SECTION_TYPE"), F.lit(0.7), s))).otherwise(empty)
        b = F.when(F.arrays_overlap(toks, concl), F.array(_entity(
            "cue", i * 2 + 1, F.lit("Conclusion"), F.lit("SECTION_TYPE"), F.lit(0.7), s))).otherwise(empty)
        return F.concat(a, b)

    return F.flatten(F.transform(F.slice(first_sentences, 1, 5), per_sentence))


# --- E6 / E7 -----------------------------------------------------------------
def default_entity_array() -> Column:
    return F.array(*[_entity("default", F.lit(i), F.lit(t), F.lit(lab), F.lit(c), F.lit(ctx))
                     for i, (t, lab, c, ctx) in enumerate(V.DEFAULT_ENTITIES)])


def ensure_entity_array(ents: Column) -> Column:
    """The two default entities when nothing was found."""
    return F.when(F.size(ents) > 0, ents).otherwise(default_entity_array())


def with_entities(df: DataFrame, text_col: str = "text", sents_col: str | None = None) -> DataFrame:
    """``df`` plus ``entities`` = E1, E2, E3, E5 in emission order, or
    E6's defaults.  ``sents_col`` may name an existing sentence array."""
    text = F.col(text_col)
    sents = F.col(sents_col) if sents_col else sentence_array(text)
    allents = F.concat(pattern_entity_array(text), structure_entity_array(text),
                       format_entity_array(text), cue_entity_array(sents))
    return with_arrays(df, entities=let_(allents, ensure_entity_array))


def entities(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """E7 long form: one row per mention, (doc_id, source, ord, text, label,
    confidence, context, start, end)."""
    d = with_entities(df.select(id_col, text_col), text_col)
    return d.select(id_col, F.inline("entities"))


def legal_entities(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """E1 + E4 (the rule NER model): pattern entities, then legal terms that
    do not overlap them, all with the confidence of their word count."""
    d = with_arrays(df.select(id_col, text_col), e1=by_name(pattern_entity_array, text_col))
    d = d.select(id_col, by_name(_ruled, text_col, "e1").alias("e"))
    return d.select(id_col, F.inline("e"))


def _ruled(text: Column, e1: Column) -> Column:
    ruled = F.transform(e1, lambda e: e.withField("confidence", _word_confidence(e["text"])))
    return F.concat(ruled, legal_term_array(text, e1))


# --- E8 / E9 / E10 -----------------------------------------------------------
def entities_by_label(ents: Column) -> Column:
    """Map label -> mentions, labels in first-appearance order.
    ``ents`` must be a plain column (not an expression) — it is read once
    per label."""
    labels = F.array_distinct(F.transform(ents, lambda e: e["label"]))
    return F.map_from_entries(F.transform(labels, lambda lab: F.struct(
        lab.alias("key"), F.filter(ents, lambda e: e["label"] == lab).alias("value"))))


def entity_type_dim(spark) -> DataFrame:
    return spark.createDataFrame(list(V.ENTITY_TYPES), "label string, description string")


def describe_entities(ents: DataFrame) -> DataFrame:
    """Description per label ("" when unknown); the label table is a
    fixed 7-row dimension, so it is broadcast."""
    dim = F.broadcast(entity_type_dim(ents.sparkSession))
    return ents.join(dim, "label", "left").withColumn(
        "description", F.coalesce("description", F.lit("")))


def clause_key_terms(sections: DataFrame, text_col: str = "text") -> DataFrame:
    """Comma-joined entity texts found inside each clause."""
    return sections.withColumn("key_terms", F.array_join(F.transform(
        pattern_entity_array(F.col(text_col)), lambda e: e["text"]), ", "))


# --- E11 ---------------------------------------------------------------------
def _is_word(ch: Column) -> Column:
    return ch.rlike(r"^[\p{L}\p{N}_]$")


def _boundary(text: Column, p: Column) -> Column:
    before = F.substring(text, p, 1)      # character p-1 (0-based)
    after = text.substr(p + 1, F.lit(1))  # character p
    return (p == 0) | (p == F.length(text)) | ~(_is_word(before) & _is_word(after))


def span_is_valid(text, start, end) -> Column:
    """A span is usable when it lies inside the text, is non-empty, does not
    start or end on whitespace, and both ends fall on token boundaries."""
    text, start, end = col_(text), col_(start), col_(end)
    first = text.substr(start + 1, F.lit(1))
    last = text.substr(end, F.lit(1))
    ws = f"^{V.WS}$"
    return ((start >= 0) & (end <= F.length(text)) & (start < end)
            & ~first.rlike(ws) & ~last.rlike(ws)
            & _boundary(text, start) & _boundary(text, end))


def valid_spans(df: DataFrame, text_col: str = "text", spans_col: str = "entities") -> DataFrame:
    """Keep spans on token boundaries, drop examples left with none."""
    out = df.withColumn(spans_col, F.filter(
        F.col(spans_col), lambda e: span_is_valid(F.col(text_col), e["start"], e["end"])))
    return out.filter(F.size(spans_col) > 0)


def require_examples(df: DataFrame) -> DataFrame:
    """E11's failure rule: raise when no example remains (one cheap action)."""
    if df.isEmpty():
        raise ValueError("No valid training examples provided")
    return df
