"""Ingest: file metadata, admission, markup and page/paragraph assembly,
property and table normalisation, media inventory (S2, S3, S12-S17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clauselake import vocab as V
from clauselake.functions.arrays import with_arrays
from clauselake.functions.text import clean_app, clean_basic, col_, squash, strip, word_count


# --- S2 ----------------------------------------------------------------------
def iso_format(ts) -> Column:
    """Python ``datetime.isoformat()``: seconds, plus microseconds when
    non-zero."""
    ts = col_(ts).cast("timestamp")
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.unix_micros(ts) % 1_000_000 != 0,
                  F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).otherwise(base)


def path_parts(path) -> dict:
    name = F.element_at(F.split(col_(path), "/"), -1)
    return {
        "filename": name,
        "suffix": F.regexp_extract(name, r"(?<=.)(\.[^./]*)$", 1),
        "stem": F.regexp_replace(name, r"(?<=.)\.[^./]*$", ""),
    }


def file_metadata(spark: SparkSession, pattern: str) -> DataFrame:
    """One row per file matching ``pattern``: filename, file_size,
    created/modified ISO dates (no ctime in Spark: created := modified),
    file_type = suffix upper-cased without the dot, title = stem, author
    "Unknown", creation_date = created.  The ``content`` column is never
    selected, so file bodies are not read."""
    f = spark.read.format("binaryFile").load(pattern).select("path", "length", "modificationTime")
    p = path_parts("path")
    iso = iso_format("modificationTime")
    return f.select(
        "path", p["filename"].alias("filename"), F.col("length").alias("file_size"),
        iso.alias("created_date"), iso.alias("modified_date"),
        F.upper(F.regexp_replace(p["suffix"], r"^\.", "")).alias("file_type"),
        p["stem"].alias("title"), F.lit("Unknown").alias("author"), iso.alias("creation_date"))


def metadata_map(filename, file_size, modified) -> Column:
    """The analyser's metadata record as map<string,string> (S2 fields)."""
    p = path_parts(filename)
    iso = iso_format(modified)
    return F.create_map(
        F.lit("filename"), p["filename"],
        F.lit("file_size"), col_(file_size).cast("string"),
        F.lit("created_date"), iso,
        F.lit("modified_date"), iso,
        F.lit("file_type"), F.upper(F.regexp_replace(p["suffix"], r"^\.", "")),
        F.lit("title"), p["stem"],
        F.lit("author"), F.lit("Unknown"),
        F.lit("creation_date"), iso)


# --- S3 ----------------------------------------------------------------------
REJECT_REASONS = ("missing", "empty_file", "too_large", "unsupported_type", "no_text", "too_short")


def rejection_reason(filename="filename", file_size="file_size", text="text") -> Column:
    """S3: the first failing admission rule, in the reference order; NULL
    when the document is admitted."""
    fn, size, txt = col_(filename), col_(file_size), col_(text)
    suffix = F.lower(F.regexp_extract(fn, r"\.([^./]*)$", 1))
    return (F.when(fn.isNull() | size.isNull(), "missing")
            .when(size == 0, "empty_file")
            .when(size > V.MAX_FILE_BYTES, "too_large")
            .when(~suffix.isin(*V.ALLOWED_SUFFIXES), "unsupported_type")
            .when(txt.isNull() | (strip(txt) == ""), "no_text")
            .when(word_count(txt) < V.MIN_WORDS, "too_short"))


def extracted_text(filename="filename", text="text") -> Column:
    """The text that is analysed: of a PDF the N1 chain (one line), of any
    other file the stripped text with its lines."""
    pdf = F.lower(F.regexp_extract(col_(filename), r"\.([^./]*)$", 1)) == "pdf"
    return F.when(pdf, clean_app(col_(text))).otherwise(strip(col_(text)))


def admit(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S3: (accepted, rejected-with-reason).  Raising becomes a quarantine
    table; both outputs are filters over one reason column.

    The reason is computed behind a Generate node: the rules are regex
    work over the whole text, and a plain filter would be pushed below a
    preceding repartition into the (possibly few) scan tasks."""
    r = with_arrays(df, reason=rejection_reason())
    return r.filter(F.col("reason").isNull()).drop("reason"), r.filter(F.col("reason").isNotNull())


# --- S12 ---------------------------------------------------------------------
def html_to_text(html) -> Column:
    """script/style blocks, comments and tags removed, basic entities
    decoded, then N2 (whitespace squashed, empty -> NULL)."""
    t = F.regexp_replace(col_(html), r"(?is)<script\b.*?</script[^>]*>", " ")
    t = F.regexp_replace(t, r"(?is)<style\b.*?</style[^>]*>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                 ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return clean_basic(t)


def join_pages(doc_pages: DataFrame, doc_col: str = "doc_id", page_col: str = "page",
               text_col: str = "text") -> DataFrame:
    """S12, page form: a document's page texts in page order, white space
    squashed, empty pages skipped, joined by a space, then N1."""
    g = doc_pages.groupBy(doc_col).agg(F.sort_array(F.collect_list(F.struct(
        F.col(page_col).alias("n"), squash(F.coalesce(F.col(text_col), F.lit(""))).alias("t")))).alias("_p"))
    full = F.filter(F.transform("_p", lambda x: x["t"]), lambda t: t != "")
    return with_arrays(g, _joined=F.array_join(full, " ")).select(doc_col, clean_app("_joined").alias("text"))


def pages_to_text(pages: DataFrame) -> DataFrame:
    """S12 over ``pages``: (page_id, url, text)."""
    return pages.select("page_id", "url", html_to_text("html").alias("text"))


# --- S13 / S14 ---------------------------------------------------------------
def assemble_pages(doc_pages: DataFrame, doc_col: str = "doc_id", page_col: str = "page",
                   text_col: str = "text") -> DataFrame:
    """Pages in page order joined with newlines (NULL page -> ""),
    total_pages, and the page texts as an array.  One row is one document,
    whatever its size (the size rule belongs to admission, S3)."""
    g = doc_pages.groupBy(doc_col).agg(F.sort_array(F.collect_list(F.struct(
        F.col(page_col).alias("n"), F.coalesce(F.col(text_col), F.lit("")).alias("t")))).alias("_p"))
    pages = F.transform("_p", lambda x: x["t"])
    return g.select(doc_col, F.array_join(pages, "\n").alias("text"),
                    F.size("_p").alias("total_pages"), pages.alias("pages"))


def assemble_paragraphs(paras: DataFrame, doc_col: str = "doc_id", order_col: str = "para_no",
                        text_col: str = "text", keep_blank: bool = False) -> DataFrame:
    """Non-blank paragraphs joined with newlines + total_paragraphs.
    ``keep_blank`` joins every paragraph and strips the result (the
    analyser's variant)."""
    p = paras if keep_blank else paras.filter(strip(F.col(text_col)) != "")
    g = p.groupBy(doc_col).agg(F.sort_array(F.collect_list(F.struct(
        F.col(order_col).alias("n"), F.coalesce(F.col(text_col), F.lit("")).alias("t")))).alias("_p"))
    text = F.array_join(F.transform("_p", lambda x: x["t"]), "\n")
    if keep_blank:
        text = strip(text)
    return g.select(doc_col, text.alias("text"), F.size("_p").alias("total_paragraphs"))


# --- S15 ---------------------------------------------------------------------
PROPERTY_TEXT = ("title", "author", "creator", "producer", "last_modified_by", "category",
                 "keywords", "subject")


def doc_properties(props: DataFrame, sections: DataFrame | None = None,
                   tables: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """Text properties NULL -> "", timestamps -> ISO string ("" when
    NULL), revision NULL -> 0.  ``section_count`` and ``table_count`` are the
    rows of ``sections`` and ``tables`` of a document (0: none) where those are
    given; other count columns pass through."""
    out = props
    for name, rows in (("section_count", sections), ("table_count", tables)):
        if rows is not None:
            n = rows.groupBy(id_col).agg(F.count(F.lit(1)).cast("int").alias(name))
            out = out.drop(name).join(n, id_col, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    for c in PROPERTY_TEXT:
        if c in props.columns:
            out = out.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit("")))
    for c in ("created", "modified", "creation_date", "modification_date"):
        if c in props.columns:
            out = out.withColumn(c, F.coalesce(iso_format(c), F.lit("")))
    if "revision" in props.columns:
        out = out.withColumn("revision", F.coalesce(F.col("revision").cast("int"), F.lit(0)))
    return out


# --- S16 ---------------------------------------------------------------------
def normalize_tables(tables: DataFrame, strip_cells: bool = False) -> DataFrame:
    """NULL cells -> "" (stripped for the DOCX variant), all-empty
    tables dropped; rows, columns (= width of the first row).  Page and
    table numbers are assigned before the drop and kept."""
    def cell(c):
        c = F.coalesce(c, F.lit(""))
        return strip(c) if strip_cells else c

    rows = F.transform("rows", lambda r: F.transform(r, cell))
    out = tables.withColumn("rows", rows)
    out = out.filter(F.exists(F.flatten("rows"), lambda c: c != ""))
    return out.withColumn("n_rows", F.size("rows")).withColumn(
        "n_columns", F.coalesce(F.size(F.get(F.col("rows"), 0)), F.lit(0)))


def order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture for S16: one table per order (rows = its line items as
    [linenumber, returnflag, linestatus or NULL]); all-empty when
    K % 13 = 0; document = K div 10, page = (K % 10) div 4 + 1, table
    number within the page by K."""
    from clauselake.sources.tables import table

    li = table(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey")
    cells = F.array(F.col("l_linenumber").cast("string"), F.col("l_returnflag"),
                    F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linestatus")))
    empty = F.array(F.lit(""), F.lit(None).cast("string"), F.lit(""))
    masked = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linestatus"))
    t = li.groupBy(k.alias("order_key")).agg(F.sort_array(F.collect_list(F.struct(
        F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("f"), masked.alias("s"),
        F.when(k % 13 == 0, empty).otherwise(cells).alias("r")))).alias("_r"))
    t = t.select("order_key", F.transform("_r", lambda x: x["r"]).alias("rows"),
                 (F.col("order_key") / 10).cast("long").alias("doc_id"),
                 ((F.col("order_key") % 10) / 4 + 1).cast("int").alias("page"))
    w = Window.partitionBy("doc_id", "page").orderBy("order_key")
    return t.withColumn("table_number", F.row_number().over(w))


# --- S17 ---------------------------------------------------------------------
def image_format(content) -> Column:
    """Format by magic bytes: FFD8 -> jpeg, 89504E47 -> png, else png."""
    h = F.hex(F.substring(col_(content), 1, 4))
    return F.when(h.startswith("FFD8"), "jpeg").when(h.startswith("89504E47"), "png").otherwise("png")


def media_inventory(blobs: DataFrame, per_page: bool = True) -> DataFrame:
    """Image number (within page for PDF, within document for DOCX
    after the extension filter) and format."""
    if per_page:
        w = Window.partitionBy("doc_id", "page").orderBy("blob_no")
        out = blobs.withColumn("format", image_format("content"))
    else:
        ext = F.lower(F.regexp_extract("name", r"\.([^./]*)$", 1))
        out = blobs.filter(ext.isin("png", "jpg", "jpeg", "gif")).withColumn("format", ext)
        w = Window.partitionBy("doc_id").orderBy("blob_no")
    return out.withColumn("image_number", F.row_number().over(w)).drop("content")


def page_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture for S17: a binary blob per page with a JPEG, PNG or unknown
    signature by page_id % 3."""
    from clauselake.sources.tables import table

    p = table(spark, sf_dir, "pages")
    body = F.encode("url", "UTF-8")
    content = (F.when(F.col("page_id") % 3 == 0, F.concat(F.unhex(F.lit("FFD8FFE0")), body))
               .when(F.col("page_id") % 3 == 1, F.concat(F.unhex(F.lit("89504E470D0A1A0A")), body))
               .otherwise(body))
    return p.select((F.col("page_id") / 10).cast("long").alias("doc_id"),
                    ((F.col("page_id") % 10) / 3 + 1).cast("int").alias("page"),
                    F.col("page_id").alias("blob_no"), content.alias("content"))
