"""Expected values derived by hand from the behaviour being reproduced
"""

from pyspark.sql import functions as F

from clauselake.functions.text import date_mentions
from clauselake.operators import classify as C
from clauselake.operators import entities as E
from clauselake.operators import metrics as A
from clauselake.operators import segment as G
from clauselake.operators import summary as M
from clauselake.plans.analyze import analyze
from clauselake.sources.ingest import admit

# A mooring lease; expected titles and categories are worked out by hand from
# the header shapes and clause patterns.
SAMPLE = """Harbour office, berth ledger 7

Lessor: the harbour office of Port Brin
VESSEL:
the sloop Marigold, nine metres, blue hull

1. Mooring Term
The berth is let from 3/4/2031 until the harbour freezes, and the owner knows that dates may shift.
The harbour office cannot promise shelter from northern storms in the open basin.

2. Fees And Fuel
A season costs $840 and the owner must settle it before the first night afloat.
Fuel means diesel from the north pump, drawn by the harbour crew on request.
"""


def one(spark, text, **cols):
    data = {"doc_id": 1, "text": text}
    data.update(cols)
    return spark.createDataFrame([data])


def test_header_sections_titles(spark):
    rows = G.header_sections(one(spark, SAMPLE)).orderBy("sec_no").collect()
    assert [r.title for r in rows] == ["Lessor:", "VESSEL:", "1. Mooring Term", "2. Fees And Fuel"]
    # text before the first header belongs to no section; a body reaches to the next header
    assert rows[1].text == "VESSEL:\nthe sloop Marigold, nine metres, blue hull"
    assert rows[3].text.count("\n") == 2


def test_clause_rule_examples(spark):
    df = spark.createDataFrame([
        (1, "Fuel means diesel from the north pump."),
        (2, "The crew must rinse the deck."),
        (3, "Dogs cannot sleep in the sail loft."),
        (4, "Gulls circle over the pier."),
    ], "doc_id long, text string")
    c = C.classify_clause(F.col("text"))
    got = {r.doc_id: r.category for r in df.select("doc_id", c["category"].alias("category")).collect()}
    assert (got[1], got[2], got[3]) == ("DEFINITION", "OBLIGATION", "RESTRICTION")
    dates = spark.createDataFrame([("Launched Mar 9, 2030, sold 1-2-31, not 2031.",)], "t string")
    assert dates.select(date_mentions("t")).first()[0] == ["Mar 9, 2030", "1-2-31"]


def test_span_prf_example(spark):
    pred = spark.createDataFrame([(1, 0, 3, "PARTY"), (1, 5, 9, "DATE")], "doc_id long, start int, end int, label string")
    gold = spark.createDataFrame([(1, 0, 3, "PARTY"), (1, 4, 9, "DATE")], "doc_id long, start int, end int, label string")
    r = {x.label: x for x in A.span_prf(pred, gold).collect()}
    assert (r["PARTY"].precision, r["PARTY"].recall, r["PARTY"].f1) == (1.0, 1.0, 1.0)
    assert (r["DATE"].precision, r["DATE"].recall, r["DATE"].f1) == (0.0, 0.0, 0.0)
    assert abs(r["overall"].f1 - 1 / 7) < 1e-12
    kinds = sorted((x.kind, x.label) for x in A.span_diff(pred, gold).collect())
    assert kinds == [("fn", "DATE"), ("fp", "DATE"), ("tp", "PARTY")]


def test_part_fires_on_party(spark):
    d = one(spark, "The party of the first kind.")
    rows = d.select(F.inline(E.format_entity_array(F.col("text")))).collect()
    assert [(r.text, r.label) for r in rows] == [("Part", "SECTION_TYPE")]


def test_admission_reasons(spark):
    df = spark.createDataFrame([
        (1, "a.pdf", 0, ""), (2, None, None, None), (3, "notes.txt", 100, "one two three four five six seven eight nine ten"),
        (4, "short.docx", 10, "too short"), (5, "big.pdf", 11 * 1024 * 1024, "x"),
        (6, "ok.PDF", 100, "one two three four five six seven eight nine ten"),
    ], "doc_id long, filename string, file_size long, text string")
    acc, rej = admit(df)
    reasons = {r.doc_id: r.reason for r in rej.collect()}
    assert reasons == {1: "empty_file", 2: "missing", 3: "unsupported_type", 4: "too_short", 5: "too_large"}
    assert [r.doc_id for r in acc.collect()] == [6]


def test_same_text_two_routes(spark):
    """The same text through a .pdf and a .docx name gives the same
    summary, clause types and entity labels."""
    line = " ".join(SAMPLE.split())  # without line ends both readers hand on the same
    df = spark.createDataFrame([(1, "sample.pdf", line, len(line)), (2, "sample.docx", f"\n{line} ", len(line))],
                               "doc_id long, filename string, text string, file_size long")
    rows = sorted(analyze(df, "2024-01-01 00:00:00").collect())
    assert len(rows) == 2
    a, b = rows
    assert a.summary.summary == b.summary.summary
    assert [s.type for s in a.sections] == [s.type for s in b.sections]
    assert sorted({e.label for e in a.entities}) == sorted({e.label for e in b.entities})
    assert a.file_type == "pdf" and b.file_type == "docx"
    assert a.summary.status == "success" and a.summary.document_type == "document"
    assert a.risks == [] and a.analysis_status == "success"


def test_pdf_text_is_one_line(spark):
    text = "First part , of a long enough text.\n\nSecond part .. of it all."
    df = spark.createDataFrame([(1, "a.PDF", text, 9), (2, "a.docx", text, 9)], "doc_id long, filename string, text string, file_size long")
    got = {r.doc_id: [s.text for s in r.sections] for r in analyze(df, "2024-01-01 00:00:00").collect()}
    assert len(got[2]) == 2 and "\n" not in got[1][0] and "part, of" in got[1][0]


def test_summary_degenerate_branches(spark):
    df = spark.createDataFrame([(1, "   "), (2, "Too few. Words here.")], "doc_id long, text string")
    r = {x.doc_id: x for x in M.summarize(df).collect()}
    assert r[1].status == "error" and r[1].document_type == "empty document"
    assert r[2].status == "ok" and r[2].original_length == 4


def test_summary_float_ties_follow_reference_order(spark):
    # 1.5 * 0.8 = 1.2000000000000002 beats 1.0 * 1.2 = 1.2 in double arithmetic
    long_first = "Alpha " + " ".join(["word"] * 31) + "."
    mid = "Beta " + " ".join(["word"] * 11) + "."
    sents = [long_first] + [mid] * 9 + ["Gamma one two three four five six seven eight nine ten eleven."]
    df = spark.createDataFrame([(1, " ".join(sents))], "doc_id long, text string")
    s = M.summarize(df).first().summary
    assert s.split("\n\n")[1].startswith("Alpha")


def test_vocabulary_cut_counts_terms_only(spark):
    # five terms by count: buoy 3, rope 2, then one each; "12" has no letters
    # run of two and "!" no term at all, which must not take a place
    text = "Buoy buoy buoy. ! . 1. Rope rope. Anchor. Oar."
    df = one(spark, text)
    both = [M.summarize_tfidf(df, max_length=1, max_features=n).first().summary for n in (1, 2)]
    assert both[0].startswith("Buoy") and both[1].startswith(("Buoy", "Rope"))


def test_invalid_spans_are_dropped(spark):
    text = "berth Nine Corp buoy"  # the name stands at 6 to 15
    df = spark.createDataFrame([(1, text, [(6, 15, "PARTY"), (7, 12, "PARTY")]),
                                (2, text, [(6, 15, "PARTY")])],
                               "doc_id long, text string, entities array<struct<start:int,end:int,label:string>>")
    out = {r.doc_id: [(e.start, e.end) for e in r.entities] for r in E.valid_spans(df).collect()}
    assert out == {1: [(6, 15)], 2: [(6, 15)]}  # a span inside a word goes


def test_key_points_and_summaries(spark):
    d = one(spark, SAMPLE)
    kp = [r.key_point for r in G.key_points(d).orderBy("kp_no").collect()]
    assert len(kp) == 3 and all(len(k.split()) > 5 for k in kp)
    s = spark.createDataFrame([("One. Two. Three.",), ("...",)], "s string")
    got = [r[0] for r in s.select(M.summaries_array(F.col("s"))).collect()]
    assert got[0] == ["One. Two. Three.", "One  Two"]
    assert got[1] == ["...", "..."]


def test_clause_lines_in_generated_code(spark):
    """C2's scores need no higher-order function, and odd letters fold as before."""
    import re

    from clauselake import vocab as V
    from clauselake.operators.classify import classify_clause, classify_lines

    texts = ["", "x", "The seller SHALL ship and shall pay", "ſhall pay", "She may not pay; he cannot pay; they cannot go",
             "Secret data and damages paid", "Keep means all", "shall pay", "non-disclosure of it", "terminat", "WARRANTIES end of it"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    lines = classify_lines(df)
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan.lower() and "transform(" not in plan
    one = {r.doc_id: r.c for r in df.select("doc_id", classify_clause("text").alias("c")).collect()}
    for r in lines.collect():
        points = []
        for _, patterns in V.CLAUSE_RULES:
            found = [len(re.findall(p.replace(r"\s", r"[ \t\n\r\f\x0b]"), r.line, re.I)) for p in patterns]
            points.append(sum(0 if n == 0 else min(1 + 2 * n, 7) for n in found))
        names = [c for c, _ in V.CLAUSE_RULES]
        best = max(range(len(points)), key=lambda i: (points[i], -i))
        total = sum(points)
        assert (r.category, r.confidence) == (names[best], points[best] / total if total else 0.0), r.line
        assert (one[r.doc_id].category, one[r.doc_id].confidence) == (r.category, r.confidence)
