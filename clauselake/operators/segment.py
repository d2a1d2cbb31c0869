"""Segmentation: sentences, paragraphs, sections, key points.

Each operator first builds a per-document array with built-in functions
(no shuffle, the document never leaves the task that read it) and then
explodes it when a long table is wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake import vocab as V
from clauselake.functions.arrays import let_, with_arrays
from clauselake.functions.text import col_, ellipsize, jre, more_words_than, strip, word_count
from clauselake.operators.boundary import BoundaryModel, sentences_of
from clauselake.operators.classify import section_type

SECTION_TYPE = "struct<sec_no:int,title:string,text:string,type:string,confidence:double>"


# --- G1 ----------------------------------------------------------------------
def sentences(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", model: BoundaryModel | None = None) -> DataFrame:
    """G1 long form: (doc_id, pos, sentence, n_words); ``model`` holds learned
    boundaries."""
    out = df.select(id_col, F.posexplode(sentences_of(F.col(text_col), model)).alias("pos", "sentence"))
    return out.withColumn("n_words", word_count("sentence"))


# --- sections ----------------------------------------------------------------
def _section(sec_no: Column, title: Column, text: Column, typ: Column, conf: Column) -> Column:
    return F.struct(sec_no.cast("int").alias("sec_no"), title.alias("title"), text.alias("text"),
                    typ.alias("type"), conf.cast("double").alias("confidence"))


def paragraph_array(text, sep: str = "\n\n") -> Column:
    """Stripped non-empty pieces of ``text.split(sep)`` as sections,
    title = first 50 characters, type by C1."""
    pieces = F.filter(F.transform(F.split(col_(text), r"\Q" + sep + r"\E"), lambda p: strip(p)),
                      lambda p: p != "")
    return F.transform(pieces, lambda p, i: _typed_section(i, p))


def _typed_section(i: Column, p: Column) -> Column:
    return let_(section_type(p), lambda st: _section(i, ellipsize(p, 50), p, st["type"], st["confidence"]))


def sentence_group_array(sents: Column, n: int = 3) -> Column:
    """Groups of ``n`` sentences joined by a space; the first titled
    "Document Content", group g >= 1 titled "Section {g + 1}"."""
    n_groups = F.ceil(F.size(sents) / F.lit(n)).cast("int")
    groups = F.when(n_groups > 0, F.sequence(F.lit(0), n_groups - 1)).otherwise(
        F.expr("CAST(array() AS array<int>)"))
    return F.transform(groups, lambda g: _section(
        g,
        F.when(g == 0, F.lit("Document Content")).otherwise(
            F.concat(F.lit("Section "), (g + 1).cast("string"))),
        F.array_join(F.slice(sents, g * n + 1, n), " "),
        F.lit("CONTENT_SECTION"), F.lit(0.8)))


def whole_text_section(text) -> Column:
    """The single section used when nothing else was found."""
    return F.array(_section(F.lit(0), F.lit("Document Content"), ellipsize(text, 1000),
                            F.lit("CONTENT_SECTION"), F.lit(1.0)))


def ensure_section_array(secs: Column, text) -> Column:
    """``secs``, or the whole-text section when ``secs`` is empty."""
    return F.when(F.size(secs) > 0, secs).otherwise(whole_text_section(text))


def _explode_sections(df: DataFrame, id_col: str, arr: Column) -> DataFrame:
    return df.select(id_col, F.inline(arr))


def paragraph_sections(df: DataFrame, sep: str = "\n\n", text_col: str = "text",
                       id_col: str = "doc_id") -> DataFrame:
    """G2 long form: (doc_id, sec_no, title, text, type, confidence)."""
    return _explode_sections(df, id_col, paragraph_array(F.col(text_col), sep))


def sentence_sections(df: DataFrame, n: int = 3, text_col: str = "text",
                      id_col: str = "doc_id", model: BoundaryModel | None = None) -> DataFrame:
    """G3 long form."""
    d = with_arrays(df.select(id_col, text_col), s=sentences_of(F.col(text_col), model))
    return _explode_sections(d, id_col, sentence_group_array(F.col("s"), n))


def ensured_sections(docs: DataFrame, sep: str = "\n\n", text_col: str = "text",
                     id_col: str = "doc_id") -> DataFrame:
    """G4 long form: G2's sections, or the whole-text section for documents
    that have none, in one pass over the documents."""
    d = with_arrays(docs.select(id_col, text_col), _secs=paragraph_array(F.col(text_col), sep))
    return _explode_sections(d, id_col, ensure_section_array(F.col("_secs"), F.col(text_col)))


# --- G5 ----------------------------------------------------------------------
_H = V.WS_CHARS.replace(r"\n", "")           # whitespace inside one line
# numbered "1. Definitions": after the capital, at least one more character
# of the *stripped* line, i.e. some non-whitespace character.
_P1 = rf"\p{{Nd}}+\.[{_H}]*[A-Z][^\n]*[^{V.WS_CHARS}]"
_P2 = rf"[A-Z][A-Z{_H}]+:"                    # all caps   "ARTICLE I:"
_P3 = rf"[A-Z][a-z]+(?:[{_H}]+[A-Z][a-z]+)*:"  # title case "Payment Terms:"


def header_line_regex() -> str:
    """A whole line whose stripped text starts with one of the three header
    shapes (G5).  Multi-line mode; only ``\\n`` ends a line."""
    return rf"(?md)^[{_H}]*(?:{_P1}|{_P2}|{_P3})[^\n]*$"


def header_title(line: Column) -> Column:
    """Title of a header line: the first pattern that matches wins."""
    s = strip(line)
    out = None
    for p in V.SECTION_HEADER_PATTERNS:
        t = F.when(s.rlike(jre(p)), strip(F.regexp_extract(s, jre(p), 1)))
        out = t if out is None else F.coalesce(out, t)
    return out


def header_section_array(text) -> Column:
    """Sections delimited by header lines.  Text before the first
    header is dropped; a section's text is its header line (unstripped) and
    the following lines up to the next header, stripped at the end."""
    rx = header_line_regex()
    heads = F.regexp_extract_all(col_(text), F.lit(rx), 0)
    pieces = F.split(col_(text), rx)
    bodies = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
    secs = F.zip_with(heads, bodies, lambda h, b: F.struct(
        header_title(h).alias("title"), strip(F.concat(h, b)).alias("text")))
    return F.transform(secs, lambda s, i: F.struct(
        i.alias("sec_no"), s["title"].alias("title"), s["text"].alias("text")))


def header_sections(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """G5 long form: (doc_id, sec_no, title, text)."""
    return df.select(id_col, F.inline(header_section_array(F.col(text_col))))


# --- G6 ----------------------------------------------------------------------
def heading_sections(paras: DataFrame, doc_col: str = "doc_id", order_col: str = "para_no",
                     text_col: str = "text", heading_col: str = "is_heading") -> DataFrame:
    """Sections over paragraphs with a heading style.

    Blank paragraphs are dropped; a heading starts a section that runs to
    the next heading (paragraphs before the first heading are dropped).  A
    document without any heading falls back to G5 over its paragraphs
    joined by newlines.  One document has >= 1 heading -> heading mode
    (deliberate: the reproduced code needs two).

    Plan: one aggregation puts a document's paragraphs, in order, into its row
    (one shuffle on the document key; a document is one row and bounded by
    the admission limit); headings, sections and the fallback are array
    expressions of that row.
    """
    kept = paras.filter(strip(F.col(text_col)) != "").groupBy(doc_col).agg(F.sort_array(F.collect_list(
        F.struct(F.col(order_col).alias("o"), F.col(text_col).alias("text"), F.coalesce(F.col(heading_col), F.lit(False)).alias("head")))).alias("_p"))
    kept = with_arrays(kept, _h=F.filter(F.transform("_p", lambda p, i: F.when(p["head"], i)), lambda i: i.isNotNull()))
    lines = F.transform("_p", lambda p: p["text"])

    def section(at: Column, j: Column) -> Column:
        until = F.coalesce(F.get(F.col("_h"), j + 1), F.size("_p"))
        return F.struct(j.alias("sec_no"), strip(F.get(F.col("_p"), at)["text"]).alias("title"),
                        strip(F.array_join(F.slice(lines, at + 1, until - at), "\n")).alias("text"))

    return kept.select(doc_col, F.inline(F.when(F.size("_h") > 0, F.transform("_h", section)).otherwise(
        header_section_array(F.array_join(lines, "\n")))))


# --- G9 ----------------------------------------------------------------------
def key_point_array(text, model: BoundaryModel | None = None) -> Column:
    """The first three sentences with more than five words."""
    return F.slice(F.filter(sentences_of(text, model), lambda s: more_words_than(s, 5)), 1, 3)


def key_points(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", model: BoundaryModel | None = None) -> DataFrame:
    return df.select(id_col, F.posexplode(key_point_array(F.col(text_col), model)).alias("kp_no", "key_point"))
