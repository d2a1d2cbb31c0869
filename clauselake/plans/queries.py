"""Registered queries: one callable (spark, sf_dir) -> DataFrame per
operator of the inventory, over the driver's tables or data Spark derives
from them (every query's work grows with the tables).  Doubles are rounded
to 6 places and arrays are flattened to strings so results compare with
the DuckDB oracle."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselake.functions.arrays import with_arrays
from clauselake.functions.text import (clean_app, clean_basic, clean_summary, date_mentions, ellipsize,
                                       fmt_kb, fmt_percent, fmt_thousands, fmt_title, is_section_header, sentence_array,
                                       span_context, word_count,
                                       word_tokens)
from clauselake.operators import classify as C
from clauselake.operators import entities as E
from clauselake.operators import filters as FL
from clauselake.operators import metrics as A
from clauselake.operators import prep as D
from clauselake.operators import segment as G
from clauselake.operators import summary as M
from clauselake.plans.analyze import analyze
from clauselake.session import staged, work_dir
from clauselake.sources import fixtures as FX
from clauselake.sources import ingest as S
from clauselake.sources import store as ST
from clauselake.sources.tables import contracts_in, documents_as_contracts, read_contracts, spread, table

Query = Callable[[SparkSession, str], DataFrame]
ANALYZED_AT = "2024-01-01 00:00:00"  # a session-time-zone literal, not the query clock


def _r(c, nd: int = 6, name: str | None = None):
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, nd).alias(name or (c if isinstance(c, str) else None))


def docs(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


def contracts(spark, sf):
    # the contract view spreads its orders scan itself
    return contracts_in(spark, sf)


def contract_entities(spark, sf):
    return E.entities(contracts(spark, sf))


def contract_analysis(spark, sf):
    return analyze(contracts(spark, sf), ANALYZED_AT)


def gold_spans(spark, sf):
    ner = D.prepare_ner(FX.annotated_corpus(spark, sf))
    return ner.select("doc_id", F.inline("entities"))


# --- flagship ----------------------------------------------------------------
def flagship(spark, sf):
    """X1 scalar view: one row per contract."""
    return analysis_view(contract_analysis(spark, sf))


def q_x1_documents(spark, sf):
    """X1 over ``documents`` (no blank lines: sections come from X2's
    sentence-group fallback; short documents are rejected)."""
    return analysis_view(analyze(spread(documents_as_contracts(spark, sf)), ANALYZED_AT))


def analysis_view(a):
    return a.select(
        "doc_id", "filename", "file_type",
        F.col("summary.document_type").alias("document_type"),
        F.col("summary.status").alias("status"),
        F.col("summary.summary").alias("summary"),
        F.col("summary.original_length").alias("original_length"),
        F.col("summary.summary_length").alias("summary_length"),
        _r(F.col("summary.compression_ratio"), name="compression_ratio"),
        F.size("entities").alias("n_entities"),
        F.size(F.array_distinct(F.transform("entities", lambda e: e["label"]))).alias("n_entity_labels"),
        F.size("sections").alias("n_sections"),
        F.array_join(F.transform("sections", lambda s: s["type"]), "|").alias("section_types"),
        F.array_join("key_points", "|").alias("key_points"),
        F.get(F.col("summaries"), 1).alias("short_summary"),
        F.array_join("warnings", "|").alias("warnings"),
        F.size("risks").alias("n_risks"),
        "analysis_status")


# --- sources -----------------------------------------------------------------
def q_s1(spark, sf):
    return read_contracts(spark, os.path.join(sf, "documents.parquet"), ("doc_id", "lang", "n_chars"))


def q_s2(spark, sf):
    return S.file_metadata(spark, os.path.join(sf, "*.parquet")).select(
        "filename", "file_size", "file_type", "title", "author")


def q_s3(spark, sf):
    d = documents_as_contracts(spark, sf, ("pdf", "docx", "txt"))
    return d.select("doc_id", "filename", S.rejection_reason().alias("reason"))


def q_s4(spark, sf):
    path = work_dir(spark, "annotations")
    ST.write_annotations(FX.annotated_corpus(spark, sf), path)
    a = ST.read_annotations(spark, path)
    return a.select("doc_id", F.md5("text").alias("text_md5"), F.size("annotations").alias("n_annotations"),
                    F.array_join(F.transform(F.filter("annotations", lambda x: x["label"].isNotNull()), lambda x: F.concat_ws(
                        ":", x["start"].cast("string"), x["end"].cast("string"), x["label"])), ",").alias("spans"),
                    F.array_join(F.transform("annotations", lambda x: x["summary"]), "|").alias("summaries"),
                    F.get(F.filter("annotations", lambda x: x["clause_type"].isNotNull()), 0)["clause_type"]
                    .alias("clause_type"),
                    F.get(F.filter("annotations", lambda x: x["label"] == "PARTY"), 0)["start"].alias("party_start"))


def q_s5_s6(spark, sf):
    d = work_dir(spark, "datasets")
    s = D.split_rows(D.prepare_ner(FX.annotated_corpus(spark, sf)))
    ST.write_dataset(s.filter("split = 'train'").drop("split"), s.filter("split = 'test'").drop("split"), d, "ner")
    train, test = ST.load_dataset(spark, d, "ner", s.drop("split").schema)
    spans = F.array_join(F.transform("entities", lambda e: F.concat_ws(
        ":", e["start"].cast("string"), e["end"].cast("string"), e["label"])), ",")
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test"))).select(
        "doc_id", "split", "text", spans.alias("spans"))


def _merged_store(spark, sf):
    """A load and a second one of some of its contracts; analysed once, both
    loads and the second's keys read the staged rows."""
    path = work_dir(spark, "loads")
    ST.to_store_rows(contract_analysis(spark, sf), 1).write.parquet(path)
    first = spark.read.parquet(path)
    number = F.regexp_extract("filename", "([0-9]+)", 1).cast("long")
    again = first.filter(number % 9 == 0).withColumns({"file_type": F.lit("reloaded"), "load_seq": F.lit(2).cast("long")})
    return ST.merge_analysis(first, again)


def q_s7(spark, sf):
    m = _merged_store(spark, sf)
    return m.select("filename", F.date_format("analyzed_at", "yyyy-MM-dd'T'HH:mm:ss").alias("analyzed_at"), "file_type", "load_seq",
                    F.json_array_length("entities").alias("n_entities"), F.json_array_length("sections").alias("n_sections"),
                    F.get_json_object("summary", "$.document_type").alias("document_type"))


def q_s8(spark, sf):
    s = ST.parse_store(ST.to_store_rows(contract_analysis(spark, sf), 1))
    return s.select("filename", F.size("entities").alias("n_entities"), F.size("sections").alias("n_sections"),
                    F.col("summary.document_type").alias("document_type"),
                    F.col("metadata")["file_size"].alias("file_size"))


def q_s9(spark, sf):
    path = work_dir(spark, "metrics")
    g = gold_spans(spark, sf)
    ST.write_metrics(A.span_prf(FX.predicted_spans(g), g), path)
    m = ST.read_metrics(spark, path)
    return m.select("label", _r("f1"))


def q_s10(spark, sf):
    c = contracts(spark, sf)
    md = FL.filter_metadata(S.metadata_map(F.col("filename"), F.col("file_size"), F.col("modified_at")))
    return ST.export_metadata(c.select("doc_id", md.alias("metadata"))).select("doc_id", "metadata_json")


def q_s10_pretty(spark, sf):
    c = contracts(spark, sf)
    md = FL.filter_metadata(S.metadata_map(F.col("filename"), F.col("file_size"), F.col("modified_at")))
    return ST.export_metadata(c.select("doc_id", md.alias("metadata")), pretty=True).select("doc_id", "metadata_json")


def q_s11(spark, sf):
    from clauselake.operators.ml import load_model, predict_clauses, save_model, train_and_hold_out

    model, test = train_and_hold_out(D.prepare_classifier(FX.annotated_corpus(spark, sf)))
    path = work_dir(spark, "model")
    save_model(model, path)
    pred = predict_clauses(load_model(path), test)
    return pred.groupBy("predicted").agg(F.count(F.lit(1)).alias("n"))


def q_s12(spark, sf):
    return S.pages_to_text(table(spark, sf, "pages"))


def q_s12_pages(spark, sf):
    c = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")
    return S.join_pages(c)


def q_s7_sink(spark, sf):
    """Save, save an overlapping load, load, search: through the stored table."""
    path = work_dir(spark, "store")
    a = staged(contract_analysis(spark, sf), "analysis")  # both loads read it
    ST.save_analysis(ST.to_store_rows(a, 1), path)
    ST.save_analysis(ST.to_store_rows(a.filter(F.col("doc_id") % 9 == 0).withColumn("file_type", F.lit("reloaded")), 2), path)
    hits = FL.search_contracts(ST.load_analysis(spark, path), "7.PDF")
    return hits.select("filename", "file_type", F.size("entities").alias("n_entities"), F.size("sections").alias("n_sections"),
                       F.array_join(F.transform("sections", lambda s: s["type"]), "|").alias("section_types"),
                       F.col("summary.summary").alias("summary"), F.col("metadata")["file_size"].alias("file_size"))


def q_s13(spark, sf):
    c = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")
    return S.assemble_pages(c).select("doc_id", "total_pages", "text")


def q_s14(spark, sf):
    p = FX.conversation_paragraphs(spark, sf)
    return S.assemble_paragraphs(p).select("doc_id", "total_paragraphs", "text")


def q_s14_keep_blank(spark, sf):
    """S14, the analyser's variant: every paragraph joined, then stripped."""
    p = FX.conversation_paragraphs(spark, sf)
    return S.assemble_paragraphs(p, keep_blank=True).select("doc_id", "total_paragraphs", "text")


def properties(spark, sf):
    cv = FX.contract_view(spark, sf)
    k = F.col("doc_id")
    return cv.select(
        "doc_id",
        F.when(k % 4 != 0, F.concat(F.lit("Contract "), k.cast("string"))).alias("title"),
        F.when(k % 3 != 0, F.col("c_name")).alias("author"),
        F.col("modified_at").alias("created"),
        F.when(k % 5 != 0, F.col("modified_at")).alias("modified"),
        F.when(k % 6 != 0, k % 7).alias("revision"),
        F.size(F.split("text", "\n")).alias("paragraph_count"))


def q_s15(spark, sf):
    return S.doc_properties(properties(spark, sf))


def q_s16(spark, sf):
    t = S.normalize_tables(S.order_tables(spark, sf))
    return t.select("doc_id", "page", "table_number", "n_rows", "n_columns",
                    F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), ";").alias("cells"))


def q_s16_stripped(spark, sf):
    """The variant that strips cells, on cells with white space around them."""
    padded = F.transform("rows", lambda r: F.transform(r, lambda c: F.concat(F.lit(" \t"), c, F.lit("\n "))))
    t = S.normalize_tables(S.order_tables(spark, sf).withColumn("rows", padded), strip_cells=True)
    return t.select("doc_id", "page", "table_number", "n_rows", "n_columns",
                    F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), ";").alias("cells"))


def q_s17(spark, sf):
    return S.media_inventory(S.page_blobs(spark, sf)).select("doc_id", "page", "blob_no", "image_number", "format")


# --- text --------------------------------------------------------------------
def q_n1(spark, sf):
    return docs(spark, sf).select("doc_id", clean_app("text").alias("clean"))


def q_n2(spark, sf):
    return table(spark, sf, "pages").select("page_id", clean_basic("html").alias("clean"))


def q_n3(spark, sf):
    return docs(spark, sf).select("doc_id", clean_summary("text").alias("clean"))


def q_n4(spark, sf):
    return docs(spark, sf).select("doc_id", word_count("text").alias("n_words"))


def q_n5(spark, sf):
    return docs(spark, sf).select("doc_id", ellipsize("text", 50).alias("title"),
                                  ellipsize("text", 500).alias("preview"))


def q_n6(spark, sf):
    """N6 on a span a third into each document (clipped at both ends)."""
    d = docs(spark, sf)
    start = F.floor(F.length("text") / 3).cast("int")
    return d.select("doc_id", span_context(F.col("text"), start, start + 10, 50).alias("context"))


def q_n7(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", fmt_thousands("n_chars").alias("chars"),
                    fmt_kb("n_chars").alias("kb"), fmt_title("lang").alias("lang"),
                    fmt_percent(F.col("n_chars") / (F.col("n_chars") + 1000)).alias("share"))


# --- segmentation ------------------------------------------------------------
def q_g1(spark, sf):
    return G.sentences(docs(spark, sf))


def q_g2_contracts(spark, sf):
    return G.paragraph_sections(contracts(spark, sf))


def q_g2_documents(spark, sf):
    return G.paragraph_sections(docs(spark, sf), sep="\n")


def q_g3(spark, sf):
    return G.sentence_sections(docs(spark, sf))


def q_g4(spark, sf):
    return G.ensured_sections(docs(spark, sf))


def q_g5(spark, sf):
    return G.header_sections(contracts(spark, sf))


def q_g6(spark, sf):
    return G.heading_sections(FX.conversation_paragraphs(spark, sf))


def q_g7(spark, sf):
    c = contracts(spark, sf)
    lines = c.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.filter(is_section_header("line"))


def q_g8(spark, sf):
    d = with_arrays(docs(spark, sf), t=word_tokens("text"))
    return d.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


def q_g9(spark, sf):
    return G.key_points(contracts(spark, sf))


# --- classification ----------------------------------------------------------
def q_c1(spark, sf):
    s = G.paragraph_sections(contracts(spark, sf))
    return s.groupBy("type", "confidence").agg(F.count(F.lit(1)).alias("n"))


def q_c2(spark, sf):
    return C.classify_lines(contracts(spark, sf)).select("doc_id", "line_no", "category", _r("confidence"))


def q_c3_contracts(spark, sf):
    return contracts(spark, sf).select("doc_id", C.document_type("text").alias("document_type"))


def q_c3_documents(spark, sf):
    return docs(spark, sf).select("doc_id", C.document_type("text").alias("document_type"))


def _labelled_docs(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    lab = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("label"))
    return d.join(lab, "doc_id")


def q_c4(spark, sf):
    from clauselake.operators.ml import train_clause_model

    _, report = train_clause_model(_labelled_docs(spark, sf))
    return report


def q_c5(spark, sf):
    from clauselake.operators.ml import train_embedding_model

    _, report = train_embedding_model(table(spark, sf, "embeddings"))
    return report


def q_c6(spark, sf):
    from clauselake.operators.ml import predict_clauses, train_and_hold_out

    model, test = train_and_hold_out(D.prepare_classifier(FX.annotated_corpus(spark, sf)))
    return predict_clauses(model, test).select("doc_id", "predicted", "description", (F.col("confidence") > 0.5).alias("sure"))


def q_c7(spark, sf):
    from clauselake.operators.ml import class_weights

    return class_weights(_labelled_docs(spark, sf)).select("label", "n_c", _r("weight"))


def q_c8(spark, sf):
    from clauselake.operators.ml import missing_labels

    return missing_labels(D.prepare_classifier(FX.annotated_corpus(spark, sf)))


def q_c9(spark, sf):
    secs = with_arrays(contracts(spark, sf), sections=G.header_section_array(F.col("text")))
    r = C.risks(secs, list(FX.RISK_RULES))
    return r.select("doc_id", F.size("risks").alias("n_risks"),
                    F.array_join(F.transform("risks", lambda x: x["type"]), "|").alias("types"))


# --- entities ----------------------------------------------------------------
def q_e1(spark, sf):
    c = contracts(spark, sf)
    d = c.select("doc_id", F.inline(E.pattern_entity_array(F.col("text"))))
    return d.select("doc_id", "ord", "text", "label", "start", "end", "context")


def q_e2_e3(spark, sf):
    c = contracts(spark, sf)
    arr = F.concat(E.structure_entity_array(F.col("text")), E.format_entity_array(F.col("text")))
    return c.select("doc_id", F.inline(arr)).select("doc_id", "source", "ord", "text", "label", "context")


def q_e4(spark, sf):
    return E.legal_entities(contracts(spark, sf)).select(
        "doc_id", "source", "ord", "text", "label", "start", "end", _r("confidence"))


def q_e5(spark, sf):
    """E5 per header section (cue words sit early in a section)."""
    secs = G.header_sections(contracts(spark, sf))
    s = secs.select((F.col("doc_id") * 1000 + F.col("sec_no")).alias("doc_id"), "text")
    return s.select("doc_id", F.inline(E.cue_entity_array(sentence_array(F.col("text"))))).select(
        "doc_id", "ord", "text", "context")


def q_e7_documents(spark, sf):
    return E.entities(docs(spark, sf)).select("doc_id", "source", "ord", "text", "label", _r("confidence"))


def q_e7_contracts(spark, sf):
    return contract_entities(spark, sf).select("doc_id", "source", "ord", "text", "label", _r("confidence"))


def q_e8(spark, sf):
    d = E.with_entities(contracts(spark, sf).select("doc_id", "text"))
    d = with_arrays(d, m=E.entities_by_label(F.col("entities")))
    d = d.select("doc_id", F.posexplode(F.map_entries("m")).alias("label_no", "kv"))
    return d.select("doc_id", "label_no", F.col("kv.key").alias("label"), F.size("kv.value").alias("n"),
                    F.array_join(F.transform("kv.value", lambda e: e["text"]), "|").alias("texts"))


def q_e9(spark, sf):
    e = E.legal_entities(contracts(spark, sf))
    return E.describe_entities(e).select("doc_id", "source", "ord", "label", "description")


def q_e10(spark, sf):
    secs = G.header_sections(contracts(spark, sf))
    return E.clause_key_terms(secs).select("doc_id", "sec_no", "key_terms")


def e11_fixture(spark, sf):
    """D1 spans plus a mid-word copy of the PARTY span when K % 4 = 0."""
    ner = D.prepare_ner(FX.annotated_corpus(spark, sf))
    bad = F.transform(F.filter("entities", lambda e: e["label"] == "PARTY"), lambda e: F.struct(
        (e["start"] + 1).alias("start"), e["end"].alias("end"), e["label"].alias("label")))
    return ner.withColumn("entities", F.when(F.col("doc_id") % 4 == 0, F.concat("entities", bad))
                          .otherwise(F.col("entities")))


def q_e11(spark, sf):
    v = E.valid_spans(e11_fixture(spark, sf))
    return v.select("doc_id", F.size("entities").alias("n_valid"))


# --- summaries ---------------------------------------------------------------
def q_m1(src) -> Query:
    def run(spark, sf):
        s = M.summarize(src(spark, sf))
        return s.select("doc_id", "summary", "original_length", "summary_length",
                        _r("compression_ratio"), "document_type", "status", "fallback_summary")
    return run


def q_m2(spark, sf):
    s = M.summarize_legal(contracts(spark, sf))
    return s.select("doc_id", "summary", "original_length", "summary_length", _r("compression_ratio"),
                    F.array_join("key_terms", ",").alias("key_terms"))


def q_m3(spark, sf):
    return M.summarize_tfidf(docs(spark, sf)).select(
        "doc_id", "summary", "original_length", "summary_length", _r("compression_ratio"))


def q_m4(spark, sf):
    s = D.prepare_summarization(FX.annotated_corpus(spark, sf))
    return M.summary_stats(s).select("doc_id", "original_length", "summary_length", _r("compression_ratio"))


def q_m5(spark, sf):
    return M.key_phrases(docs(spark, sf))


def q_m9(spark, sf):
    s = M.summarize(contracts(spark, sf))
    return s.select("doc_id", F.get(M.summaries_array(F.col("summary")), 1).alias("short_summary"))


# --- metrics -----------------------------------------------------------------
def q_a1(spark, sf):
    a = contract_analysis(spark, sf)
    return a.select("doc_id", F.array_join("warnings", "|").alias("warnings"))


def q_a2(spark, sf):
    g = gold_spans(spark, sf)
    return A.span_prf(FX.predicted_spans(g), g).select(
        "label", "tp", "fp", "fn", _r("precision"), _r("recall"), _r("f1"))


def q_a3(spark, sf):
    g = gold_spans(spark, sf)
    return A.span_diff(FX.predicted_spans(g), g)


def q_a4(spark, sf):
    c = FX.contract_view(spark, sf)
    pred = c.select(F.col("intended_type").alias("label"), C.document_type("text").alias("prediction"))
    return A.classification_report(pred).select("label", _r("precision"), _r("recall"), _r("f1"), "support")


def q_a5(spark, sf):
    s = D.prepare_summarization(FX.annotated_corpus(spark, sf))
    # the gold summary stays in the row beside the one to be compared
    d = with_arrays(s.select("doc_id", "text", F.col("summary").alias("gold")), _sents=sentence_array(F.col("text")))
    d = M.with_summary(d, "text", sents_col="_sents")
    return d.select("doc_id", _r(A.word_overlap(F.col("summary.summary"), F.col("gold")), name="overlap"))


def q_a6(spark, sf):
    return A.entity_stats(contract_entities(spark, sf), 0.7).select("label", "n", _r("avg_confidence"))


def q_a7(spark, sf):
    return A.label_distribution(contract_entities(spark, sf)).select("label", "n", _r("share"))


def q_a8(spark, sf):
    return A.clause_stats(G.paragraph_sections(contracts(spark, sf)), 0.7).select(
        "type", "n", _r("avg_confidence"))


def q_a9(spark, sf):
    return A.clause_metrics(G.paragraph_sections(contracts(spark, sf))).select(
        "doc_id", "sec_no", _r("confidence"), "n_words", "n_sentences")


def q_a10(spark, sf):
    return A.document_kpis(contract_analysis(spark, sf), 0.7).select(
        "doc_id", "n_entities", "n_clauses", _r("avg_confidence"))


def q_a11(spark, sf):
    return A.label_options(contract_entities(spark, sf))


# --- filters -----------------------------------------------------------------
def q_f1(spark, sf):
    d = with_arrays(contracts(spark, sf).select("doc_id", "text"), d=date_mentions("text"))
    return d.select("doc_id", F.size("d").alias("n_dates"), F.array_join("d", ", ").alias("dates"))


def q_f2(spark, sf):
    e = FL.filter_entities(contract_entities(spark, sf), 0.8, ("SECTION_TYPE", "DATE", "PARTY"), "part")
    return e.select("doc_id", "source", "ord", "text", "label")


def q_f3(spark, sf):
    s = FL.filter_clauses(G.paragraph_sections(contracts(spark, sf)), 0.85, (), "notice")
    return s.select("doc_id", "sec_no", "type")


def q_f4(spark, sf):
    c = contracts(spark, sf)
    md = FL.filter_metadata(S.metadata_map(F.col("filename"), F.col("file_size"), F.col("modified_at")), "1998")
    d = c.select("doc_id", md.alias("m")).filter(F.size("m") > 0)
    return d.select("doc_id", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("keys"))


def q_f5(spark, sf):
    a = contract_analysis(spark, sf)
    r = FL.search_contracts(a, "customer#00000001")
    return r.select("filename", F.date_format("analyzed_at", "yyyy-MM-dd'T'HH:mm:ss").alias("analyzed_at"))


def q_f6(spark, sf):
    e = contract_entities(spark, sf).withColumn(
        "source_rank", F.expr("array_position(array('ner','structure','format','cue','default'), source)"))
    t = FL.top_k(e, 2, ["doc_id"], [F.desc("confidence"), F.asc("source_rank"), F.asc("ord")])
    return t.select("doc_id", "rank", "source", "ord", "text")


# --- prep --------------------------------------------------------------------
def q_d1(spark, sf):
    n = D.prepare_ner(FX.annotated_corpus(spark, sf))
    return n.select("doc_id", F.size("entities").alias("n"), F.array_join(F.transform(
        "entities", lambda e: F.concat_ws(":", e["start"].cast("string"), e["end"].cast("string"), e["label"])),
        ",").alias("spans"))


def q_d2(spark, sf):
    return D.prepare_classifier(FX.annotated_corpus(spark, sf)).select("doc_id", "label")


def q_d3(spark, sf):
    return D.prepare_summarization(FX.annotated_corpus(spark, sf)).select("doc_id", "summary")


def q_d4(spark, sf):
    return D.split_rows(table(spark, sf, "documents").select("doc_id")).select("doc_id", "split")


def q_d5(spark, sf):
    d = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("label"))
    return D.split_stratified(d).select("doc_id", "label", "split")


# --- composite ---------------------------------------------------------------
def q_x3(spark, sf):
    from clauselake.plans.train import metric_rows, prepare_all, train_all

    d = work_dir(spark, "train")
    prepare_all(FX.annotated_corpus(spark, sf), d)
    return metric_rows(train_all(spark, d, embeddings=table(spark, sf, "embeddings")))


def q_x4(spark, sf):
    from clauselake.streaming.intake import stream_contracts

    base = work_dir(spark, "stream")
    # three intakes into one store, submitted out of order; the second has other
    # copies of its own contracts, the third of some of the second's
    c = contracts_in(spark, sf).withColumn("submitted_at", F.date_sub("modified_at", F.lit(0)).cast("timestamp") - F.expr(
        "make_dt_interval(cast(doc_id % 3 as int) * 40)"))
    for part in (1, 0, 2):
        c.filter(F.col("doc_id") % 3 == part).write.parquet(f"{base}/in/part={part}")
        if part != 1:
            copies = c.filter(F.col("doc_id") % (9 if part == 2 else 6) == 0)
            copies.withColumn("text", F.concat("text", F.lit("\nA copy that is not taken."))).write.parquet(f"{base}/in/part={part}copies")
        stream_contracts(spark, f"{base}/in/*", f"{base}/store", f"{base}/checkpoint")
    s = ST.load_analysis(spark, f"{base}/store")
    return s.select("filename", "file_type", F.size("entities").alias("n_entities"), F.size("sections").alias("n_sections"),
                    F.array_join(F.transform("sections", lambda x: x["type"]), "|").alias("section_types"),
                    F.col("summary.document_type").alias("document_type"), F.col("summary.summary").alias("summary"),
                    _r(F.col("summary.compression_ratio"), name="compression_ratio"), F.col("metadata")["file_size"].alias("file_size"),
                    F.date_format("analyzed_at", "yyyy-MM-dd'T'HH:mm:ss").alias("analyzed_at"))


def queries() -> dict[str, Query]:
    from clauselake.plans import learned

    return {
        **learned.queries(),
        "s1_scan_documents": q_s1, "s2_file_metadata": q_s2, "s3_admission": q_s3,
        "s4_read_annotations": q_s4, "s5_s6_dataset_roundtrip": q_s5_s6, "s7_merge_store": q_s7,
        "s8_load_store": q_s8, "s9_metrics_roundtrip": q_s9, "s10_export_metadata": q_s10, "s10_export_metadata_pretty": q_s10_pretty,
        "s11_model_roundtrip": q_s11, "s12_pages_to_text": q_s12, "s12_join_pages": q_s12_pages, "s7_store_save_load_search": q_s7_sink, "s13_assemble_pages": q_s13,
        "s14_assemble_paragraphs": q_s14, "s14_assemble_paragraphs_keep_blank": q_s14_keep_blank, "s15_doc_properties": q_s15, "s16_normalize_tables": q_s16,
        "s16_normalize_tables_stripped": q_s16_stripped,
        "s17_media_inventory": q_s17,
        "n1_clean_app": q_n1, "n2_clean_basic": q_n2, "n3_clean_summary": q_n3, "n4_word_count": q_n4,
        "n5_ellipsize": q_n5, "n6_span_context": q_n6, "n7_display_formats": q_n7,
        "g1_sentences": q_g1, "g2_paragraph_sections_contracts": q_g2_contracts,
        "g2_line_sections_documents": q_g2_documents, "g3_sentence_sections": q_g3,
        "g4_ensure_section": q_g4, "g5_header_sections": q_g5, "g6_heading_sections": q_g6,
        "g7_section_header_lines": q_g7, "g8_word_tokens": q_g8, "g9_key_points": q_g9,
        "c1_section_types": q_c1, "c2_classify_lines": q_c2, "c3_document_type_contracts": q_c3_contracts,
        "c3_document_type_documents": q_c3_documents, "c4_tfidf_classifier": q_c4,
        "c5_embedding_classifier": q_c5, "c6_predict_clauses": q_c6, "c7_class_weights": q_c7,
        "c8_missing_labels": q_c8, "c9_risks": q_c9,
        "e1_pattern_entities": q_e1, "e2_e3_gazetteer_entities": q_e2_e3, "e4_legal_terms": q_e4,
        "e5_cue_entities": q_e5, "e6_e7_entities_documents": q_e7_documents,
        "e7_entities_contracts": q_e7_contracts, "e8_entities_by_label": q_e8, "e9_describe_entities": q_e9,
        "e10_clause_key_terms": q_e10, "e11_valid_spans": q_e11,
        "m1_summary_contracts": q_m1(contracts), "m1_summary_documents": q_m1(docs),
        "m2_legal_summary": q_m2, "m3_tfidf_summary": q_m3, "m4_summary_stats": q_m4,
        "m5_key_phrases": q_m5, "m9_summaries": q_m9,
        "a1_warnings": q_a1, "a2_span_prf": q_a2, "a3_span_diff": q_a3, "a4_classification_report": q_a4,
        "a5_word_overlap": q_a5, "a6_entity_stats": q_a6, "a7_label_distribution": q_a7,
        "a8_clause_stats": q_a8, "a9_clause_metrics": q_a9, "a10_document_kpis": q_a10,
        "a11_label_options": q_a11,
        "f1_date_mentions": q_f1, "f2_filter_entities": q_f2, "f3_filter_clauses": q_f3,
        "f4_filter_metadata": q_f4, "f5_search_contracts": q_f5, "f6_top_k_entities": q_f6,
        "d1_prepare_ner": q_d1, "d2_prepare_classifier": q_d2, "d3_prepare_summarization": q_d3,
        "d4_split_rows": q_d4, "d5_split_stratified": q_d5,
        "x1_analyze_contracts": flagship, "x1_analyze_documents": q_x1_documents, "x3_train_all": q_x3, "x4_stream_contracts": q_x4,
    }
