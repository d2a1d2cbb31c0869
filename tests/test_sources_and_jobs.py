"""Sources, sinks, splits and the streaming intake on small inputs."""

import math
import os
import tempfile

from pyspark.sql import functions as F

from clauselake.operators import prep as D
from clauselake.operators import segment as G
from clauselake.plans.analyze import analyze
from clauselake.session import work_dir
from clauselake.sources import fixtures as FX
from clauselake.sources import ingest as S
from clauselake.sources import store as ST
from clauselake.sources.tables import contracts_in

from conftest import SF_SMALL


def test_split_sizes_are_exact(spark):
    df = spark.range(0, 1003).withColumnRenamed("id", "doc_id")
    s = D.split_rows(df)
    assert s.filter("split = 'test'").count() == math.ceil(0.2 * 1003)
    lab = df.withColumn("label", (F.col("doc_id") % 3).cast("string"))
    st = D.split_stratified(lab)
    got = {r.label: r.n for r in st.filter("split = 'test'").groupBy("label").agg(F.count("*").alias("n")).collect()}
    sizes = {r.label: r["count"] for r in lab.groupBy("label").count().collect()}
    assert got == {k: math.floor(0.2 * v + 0.5) for k, v in sizes.items()}


def test_store_upsert_and_search(spark):
    c = contracts_in(spark, SF_SMALL).limit(20)
    a = analyze(c, "2024-01-01 00:00:00")
    path = work_dir(spark, "store-test")
    ST.save_analysis(ST.to_store_rows(a, 1), path)
    ST.save_analysis(ST.to_store_rows(a.limit(5).withColumn("file_type", F.lit("again")), 2), path)
    s = ST.load_analysis(spark, path)
    assert s.count() == 20
    assert s.filter("file_type = 'again'").count() == 5
    assert s.first().summary.status == "success"


def test_store_faults_are_not_taken_for_no_store(spark):
    import pytest

    path = work_dir(spark, "store-null")
    a = ST.to_store_rows(analyze(contracts_in(spark, SF_SMALL).limit(2), "2024-01-01 00:00:00"), 1)
    with pytest.raises(Exception, match="no key"):
        ST.save_analysis(a.withColumn("analyzed_at", F.lit(None).cast("timestamp")), path)
    assert not ST._exists(spark, path)
    with pytest.raises(Exception):
        ST._exists(spark, "nosuchscheme://x/y")


def test_assembly_keeps_documents_of_any_size(spark):
    pages = spark.createDataFrame([(1, n, "x" * 3_000_000) for n in range(4)] + [(2, 0, "y")], "doc_id long, page long, text string")
    assert {r.doc_id: len(r.text) for r in S.assemble_pages(pages).collect()} == {1: 12_000_003, 2: 1}


def test_stratified_split_of_any_label_type(spark):
    rows = [(i, [True, False, None][i % 3], i % 2) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, flag boolean, number int")
    for label, sizes in (("flag", {True: 40, False: 40, None: 40}), ("number", {0: 60, 1: 60})):
        got = D.split_stratified(df, label).filter("split = 'test'").groupBy(label).count().collect()
        assert {r[0]: r["count"] for r in got} == sizes


def test_equal_column_names_of_two_tables(spark):
    from clauselake.functions.text import sentence_array

    a, b = (spark.createDataFrame([(t,)], "t string") for t in ("One. Two.", "Three."))
    assert a.select(sentence_array(a["t"])).first()[0] == ["One.", "Two."]
    assert b.select(sentence_array(b["t"])).first()[0] == ["Three."]


def test_search_with_a_backslash(spark):
    from clauselake.operators.filters import search_contracts

    s = spark.createDataFrame([("a\\b.pdf", None, None, 1), ("ab.pdf", None, None, 2)],
                              "filename string, summary struct<summary:string>, metadata map<string,string>, analyzed_at int")
    assert [r.filename for r in search_contracts(s, "a\\b").collect()] == ["a\\b.pdf"]


def test_late_contracts_are_stored(spark):
    from clauselake.streaming.intake import stream_contracts

    base = work_dir(spark, "stream-late")
    c = contracts_in(spark, SF_SMALL).limit(3).collect()
    for n, (row, day) in enumerate(zip(c, ("2024-05-10", "2024-05-11", "2024-01-01"))):
        one = spark.createDataFrame([row], contracts_in(spark, SF_SMALL).schema).withColumn("submitted_at", F.lit(day).cast("timestamp"))
        one.write.parquet(f"{base}/in/{n}")
        stream_contracts(spark, f"{base}/in/*", f"{base}/store", f"{base}/ckpt")
    assert {r.filename for r in ST.load_analysis(spark, f"{base}/store").collect()} == {r.filename for r in c}


def test_annotations_roundtrip(spark):
    a = FX.annotated_corpus(spark, SF_SMALL)
    path = work_dir(spark, "ann-test")
    ST.write_annotations(a, path)
    back = ST.read_annotations(spark, path)
    assert back.count() == a.count()
    assert D.prepare_ner(back).count() == a.count()
    assert D.prepare_classifier(back).filter("doc_id % 10 = 9").count() == 0


def test_heading_sections(spark):
    paras = spark.createDataFrame([
        (1, 0, "intro text", False), (1, 1, "Heading One", True), (1, 2, "body a", False),
        (1, 3, "  ", False), (1, 4, "Heading Two", True), (1, 5, "body b", False),
        (2, 0, "1. FIRST", False), (2, 1, "line", False),
    ], "doc_id long, para_no long, text string, is_heading boolean")
    rows = sorted((r.doc_id, r.sec_no, r.title, r.text) for r in G.heading_sections(paras).collect())
    assert rows == [(1, 0, "Heading One", "Heading One\nbody a"), (1, 1, "Heading Two", "Heading Two\nbody b"),
                    (2, 0, "1. FIRST", "1. FIRST\nline")]


def test_pages_and_tables(spark):
    pages = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, None)], "doc_id long, page long, text string")
    r = S.assemble_pages(pages).first()
    assert (r.text, r.total_pages, r.pages) == ("a\nb\n", 3, ["a", "b", ""])
    t = spark.createDataFrame([(1, 1, 1, [["x", None], ["", "y"]]), (1, 1, 2, [[None, ""]])],
                              "doc_id long, page int, table_number int, rows array<array<string>>")
    out = S.normalize_tables(t).collect()
    assert [(o.table_number, o.n_rows, o.n_columns, o.rows) for o in out] == [(1, 2, 2, [["x", ""], ["", "y"]])]


def test_html_to_text(spark):
    df = spark.createDataFrame([('<html><script>var t="</p>";</script><p>Hello &amp; bye</p><!-- x --> .</html>',)],
                               "html string")
    assert df.select(S.html_to_text("html")).first()[0] == "Hello & bye."


def test_stream_intake_dedupes(spark):
    from clauselake.streaming.intake import stream_contracts

    base = work_dir(spark, "stream-test")
    c = contracts_in(spark, SF_SMALL).withColumn("submitted_at", F.col("modified_at"))
    n = c.count()
    c.write.parquet(f"{base}/in/a")
    c.filter(F.col("doc_id") % 2 == 0).write.parquet(f"{base}/in/b")
    bad = c.limit(3).withColumn("filename", F.concat(F.lit("x_"), F.col("doc_id").cast("string"), F.lit(".txt")))
    bad.write.parquet(f"{base}/in/c")
    stream_contracts(spark, f"{base}/in/*", f"{base}/store", f"{base}/ckpt")
    s = ST.load_analysis(spark, f"{base}/store")
    assert s.count() == n
    assert s.select("filename", "analyzed_at").distinct().count() == n
    q = spark.read.parquet(f"{base}/store_rejected")
    assert {r.reason for r in q.collect()} == {"unsupported_type"} and q.count() == 3


def test_the_first_copy_is_taken_over_batches_and_restarts(spark):
    from clauselake.streaming.intake import stream_contracts

    base = work_dir(spark, "stream-copies")
    body = "The first house lets a berth to the second house until the end of the season for a fixed rent. "
    schema = "doc_id long, filename string, text string, file_size long, modified_at timestamp, submitted_at timestamp"
    day = "2024-05-10 00:00:00.123456"

    def arrive(part, rows):
        rows = [(i, name, None if text is None else body + text, 500, "2024-01-01", at) for i, name, text, at in rows]
        frame = spark.createDataFrame(rows, "doc_id long, filename string, text string, file_size long, modified_at string, submitted_at string")
        frame.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in schema.split(", ")]).write.parquet(f"{base}/in/{part}")
        stream_contracts(spark, f"{base}/in/*", f"{base}/store", f"{base}/ckpt")  # a restarted query each time

    arrive(1, [(7, "a.pdf", "Copy two is here now.", day), (7, "a.pdf", "Copy one is here now.", day), (3, "b.pdf", "Third is here now.", day),
               (2, "b.pdf", "Zebra is here now.", day), (None, "c.pdf", "No number is here now.", day)])
    arrive(2, [(1, "a.pdf", "Late copy is here now.", day), (9, "a.pdf", "Another day is here now.", "2024-05-11"), (5, "c.pdf", "Late number is here now.", day)])
    arrive(3, [(1, "b.pdf", "Very late copy is here now.", day), (4, None, "Nameless is here now.", day), (6, None, "Nameless too is here now.", day),
               (8, "d.pdf", "Keyless is here now.", None)])
    got = {(r.filename, str(r.analyzed_at)[:10]): r.summary.summary.split(". ")[-1] for r in ST.load_analysis(spark, f"{base}/store").collect()}
    assert {k: v.split(" ")[0] for k, v in got.items()} == {("a.pdf", "2024-05-10"): "Copy", ("a.pdf", "2024-05-11"): "Another", ("b.pdf", "2024-05-10"): "Zebra", ("c.pdf", "2024-05-10"): "No"}
    assert "Copy one" in got["a.pdf", "2024-05-10"]
    rejected = spark.read.parquet(f"{base}/store_rejected").collect()
    assert sorted((r.doc_id, r.reason) for r in rejected) == [(4, "missing"), (6, "missing"), (8, "missing")]


def test_file_metadata_matches_the_file_system(spark):
    rows = {r.filename: r for r in S.file_metadata(spark, os.path.join(SF_SMALL, "*.parquet")).collect()}
    assert "documents.parquet" in rows
    r = rows["documents.parquet"]
    assert r.file_size == os.stat(os.path.join(SF_SMALL, "documents.parquet")).st_size
    assert (r.file_type, r.title, r.author) == ("PARQUET", "documents", "Unknown")
    assert r.created_date == r.modified_date == r.creation_date and "T" in r.created_date


def test_media_inventory_formats(spark):
    blobs = spark.createDataFrame([
        (1, 1, 0, bytes.fromhex("FFD8FFE0") + b"x"), (1, 1, 1, bytes.fromhex("89504E470D0A") + b"y"),
        (1, 2, 2, b"plain"), (2, 1, 3, b"")], "doc_id long, page int, blob_no long, content binary")
    got = sorted((r.doc_id, r.page, r.image_number, r.format) for r in S.media_inventory(blobs).collect())
    assert got == [(1, 1, 1, "jpeg"), (1, 1, 2, "png"), (1, 2, 1, "png"), (2, 1, 1, "png")]
    named = spark.createDataFrame([(1, 0, "word/media/a.PNG"), (1, 1, "word/media/b.emf"), (1, 2, "c.jpg")],
                                  "doc_id long, blob_no long, name string")
    got = sorted((r.blob_no, r.image_number, r.format) for r in S.media_inventory(named, per_page=False).collect())
    assert got == [(0, 1, "png"), (2, 2, "jpg")]


def test_split_is_deterministic(spark):
    df = spark.range(0, 2500).withColumnRenamed("id", "doc_id").repartition(7)
    a = {r.doc_id for r in D.split_rows(df).filter("split = 'test'").collect()}
    b = {r.doc_id for r in D.split_rows(df.repartition(3)).filter("split = 'test'").collect()}
    assert a == b and len(a) == 500


def test_train_all_reports_every_set(spark):
    from clauselake.plans.queries import q_x3

    rows = q_x3(spark, SF_SMALL).collect()
    by = {}
    for r in rows:
        by.setdefault(r["set"], {})[r.label] = r
    assert set(by) == {"classifier", "ner", "tagger", "summarization", "embedding"}
    assert by["tagger"]["PARTY"].f1 > 0.95 > by["ner"]["PARTY"].f1
    assert all(by[s]["accuracy"].support > 0 and by[s]["accuracy"].tp is None for s in ("classifier", "embedding"))
    assert by["ner"]["overall"].tp is not None and by["ner"]["overall"].overlap is None
    assert 0 <= by["summarization"]["overlap"].overlap <= 1 and by["summarization"]["overlap"].support > 0


def test_property_counts(spark):
    props = spark.createDataFrame([(1, None, 9), (2, "t", 9)], "doc_id long, title string, section_count int")
    sections = spark.createDataFrame([(1,), (1,), (3,)], "doc_id long")
    tables = spark.createDataFrame([(2,)], "doc_id long")
    got = sorted((r.doc_id, r.title, r.section_count, r.table_count) for r in S.doc_properties(props, sections, tables).collect())
    assert got == [(1, "", 2, 0), (2, "t", 0, 1)]
    assert S.doc_properties(props).columns == props.columns


def test_keys_of_a_stream_are_joined_without_python(spark):
    """A Python call for each key of the keyed state before."""
    from clauselake.streaming import intake as I

    for j in range(70):  # the folders below j have each batch once, and are few
        held = [n for top in I._below(j) for n in range(top + 1 - ((top + 1) & -(top + 1)), top + 1)]
        assert sorted(held) == list(range(j)) and len(I._below(j)) <= 7
    path = work_dir(spark, "seen-keys")
    schema = "doc_id long, filename string, text string, file_size long, modified_at timestamp, submitted_at timestamp"
    day = "2024-05-10 00:00:00.123456"

    def batch(rows):
        d = spark.createDataFrame(rows, "doc_id long, filename string, text string, submitted_at string")
        return d.withColumns({"file_size": F.lit(5), "modified_at": F.lit(None).cast("timestamp")}).select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in schema.split(", ")])

    def taken(rows, n):
        got = I.first_copies(batch(rows), path, n)
        assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
        return sorted(((r.doc_id, r.filename, r.text, str(r.submitted_at)) for r in got.collect()), key=str)

    for n in range(6):
        rows = [(n, f"f{k}.pdf", f"{x} {n}", day) for k in range(n, -1, -1) for x in "zab"] + [(n, None, "no name", day)]
        for _ in range(2):  # a re-run batch takes the same
            assert taken(rows, n) == sorted([(n, f"f{n}.pdf", f"a {n}", day), (n, None, "no name", day)], key=str)
