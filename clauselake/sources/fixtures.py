"""Deterministic contract-shaped views derived from the driver's tables.

The driver's ``documents`` hold almost no legal vocabulary, so the legal
operators run on a *contract view* rendered from ``orders ⋈ customer`` plus a
per-order line count from ``lineitem``.  The SQL text below is written in the
common subset of Spark SQL and DuckDB, so both engines render byte-identical
contracts; it scales with ``orders`` (one contract per order).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed clause templates of the contract view (test fixture values).
DEF_LINES = (
    "Guarded Matter means every confidential record that either house opens for its partner.",
    "The term Services is defined as the work listed in the order.",
    "Effective Date shall mean the day of signature by both parties.",
)
RESTRICTION_LINE = (
    "Party B may not assign or sublet any right without consent. "
    "Party B cannot resell the items."
)
TERMINATION_LINE = (
    "Termination by either side needs 30 days written notice. "
    "At the end of the period the expiration is final."
)
CONF_LINE = "Each side keeps confidential data and proprietary methods secret at all times."
LIABILITY_LINE = (
    "The liability for damages is capped. Warranty claims end after 12 months, "
    "and indemnification covers third parties only."
)
CLOSING_LINES = (
    "In conclusion this proposal is proposed to both boards; we suggest and recommend its adoption.",
    "The key purpose and main objective of this report is the analysis of findings from the study.",
    "Dear partner, with kind regards and sincerely yours.",
    "Overview: the primary goal is delivery, and the deadline is the action date of Jan 5, 2025.",
    "See the important follow up memo for the next step.",
    "Short closing line here.",
)
# Intended document type of each closing template (gold label for A4).
CLOSING_TYPES = ("proposal", "report", "letter", "memo", "memo", "legal document")


def _case(key: str, values: tuple[str, ...]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {key} % {len(values)} {arms} END"


def contract_view_sql(orders: str = "orders", customer: str = "customer",
                      lineitem: str = "lineitem") -> str:
    """One SQL text accepted unchanged by Spark SQL and DuckDB."""
    k = "o.o_orderkey"
    s = "CAST({} AS STRING)".format
    lines = [
        "'SUPPLY CONTRACT'", "''",
        f"'Signed on ' || {s('month(o.o_orderdate)')} || '/' || "
        f"{s('day(o.o_orderdate)')} || '/' || {s('year(o.o_orderdate)')} || "
        "' as an agreement of the houses named below.'",
        "''",
        "'SELLING HOUSE: ' || c.c_name || ' Corp'",
        f"'BUYING HOUSE: Supplier ' || {s('o.o_custkey % 97')} || ' Ltd.'",
        "''",
        "'1. DEFINITIONS'",
        _case(k, DEF_LINES),
        "''",
        "'2. OBLIGATIONS'",
        f"'Party A shall ship ' || {s('coalesce(l.n, 0)')} || ' crates to the dock of Party B.'",
        f"'For each month Party B must transfer $' || {s('CAST(floor(o.o_totalprice) AS BIGINT)')} || ' to the seller.'",
        f"CASE WHEN {k} % 4 = 0 THEN '{RESTRICTION_LINE}' END",
        "''",
        f"CASE WHEN {k} % 5 <> 0 THEN '3. TERMINATION' END",
        f"CASE WHEN {k} % 5 <> 0 THEN '{TERMINATION_LINE}' END",
        f"CASE WHEN {k} % 2 = 0 THEN 'Confidentiality Duties:' END",
        f"CASE WHEN {k} % 2 = 0 THEN '{CONF_LINE}' END",
        f"CASE WHEN {k} % 7 = 0 THEN '' END",
        f"CASE WHEN {k} % 7 = 0 THEN '{LIABILITY_LINE}' END",
        "''",
        _case(k, CLOSING_LINES),
    ]
    body = ",\n    ".join(lines)
    types = _case(k, CLOSING_TYPES)
    return f"""
SELECT {k} AS doc_id,
  'contract_' || {s(k)} || CASE WHEN {k} % 2 = 0 THEN '.docx' ELSE '.pdf' END AS filename,
  concat_ws(chr(10),
    {body}) AS text,
  o.o_custkey AS cust_key,
  c.c_name AS c_name,
  o.o_orderdate AS modified_at,
  {types} AS intended_type
FROM {orders} o
JOIN {customer} c ON o.o_custkey = c.c_custkey
LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM {lineitem} GROUP BY l_orderkey) l
  ON l.l_orderkey = o.o_orderkey
"""


def contract_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract view over ``sf_dir``'s orders/customer/lineitem.

    Columns: doc_id, filename, text, cust_key, c_name, modified_at,
    intended_type.  The join to ``customer`` is a dimension join; Spark's
    AQE turns it into a broadcast when the runtime size allows.
    """
    return _rendered(spark, sf_dir, contract_view_sql)


def _rendered(spark: SparkSession, sf_dir: str, sql) -> DataFrame:
    """A view's SQL over ``sf_dir``'s orders, customer and lineitem."""
    import hashlib

    from clauselake.sources.tables import spread, table

    tag = hashlib.md5(sf_dir.encode()).hexdigest()[:10]
    views = {}
    for name in ("orders", "customer", "lineitem"):
        v = f"_cl_{name}_{tag}"
        t = table(spark, sf_dir, name)
        # rendering is per-order string work: spread the orders over all
        # cores when the scan yields fewer partitions (a no-op at scale)
        (spread(t) if name == "orders" else t).createOrReplaceTempView(v)
        views[name] = v
    return spark.sql(sql(views["orders"], views["customer"], views["lineitem"]))


# --- letters: sentences with abbreviations, one letter for each order --------
def letters_sql(orders: str = "orders", customer: str = "customer", lineitem: str = "lineitem") -> str:
    """One SQL text accepted unchanged by Spark SQL and DuckDB: (doc_id, text).
    The parts vary by order key, so that abbreviations, initials, numbers after
    "No." and ordinary sentence ends all occur in several surroundings."""
    k, n = "o.o_orderkey", "CAST(coalesce(l.n, 0) AS STRING)"

    def text(x: str) -> str:
        return f"CAST({x} AS STRING)"

    parts = (
        f"'Order No. ' || {text(k)} || ' was taken by ' || c.c_name || ' Inc. for the buyer.'",
        f"CASE {k} % 3 WHEN 0 THEN 'Maple Inc. agrees to U.S. law and to no other order.' "
        f"WHEN 1 THEN 'The buyer took approx. ' || {n} || ' crates of the order.' "
        f"WHEN 2 THEN 'Mr. J. Smith signs the order for the buyer.' END",
        f"CASE {k} % 4 WHEN 0 THEN 'The order is due on Jan. ' || {text(f'{k} % 28 + 1')} || ' at noon. No delay of the order suits the buyer.' "
        f"WHEN 1 THEN 'Both met at 5 p.m. The buyer was late for the order.' "
        f"WHEN 2 THEN 'Was the buyer late? No! The order came at noon.' "
        f"WHEN 3 THEN 'See Art. ' || {text(f'{k} % 20 + 1')} || ' of the law for the crates.' END",
        "'By law the crates go to the buyer at noon, late or not, in good order.'",
        f"CASE {k} % 5 WHEN 0 THEN chr(10) || chr(10) || 'Yours, Oak Inc.' || chr(10) || chr(10) || 'P. Reed sends the order.' END",
    )
    body = ", ".join(parts)
    return f"""
SELECT {k} AS doc_id, concat_ws(' ', {body}) AS text
FROM {orders} o
JOIN {customer} c ON o.o_custkey = c.c_custkey
LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM {lineitem} GROUP BY l_orderkey) l
  ON l.l_orderkey = o.o_orderkey
"""


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir, letters_sql)


# --- derived fixtures (FIXTURES.md section 4) --------------------------------
# Clause type of the annotated corpus by K % 3 (fixed fixture values).
FIXTURE_CLAUSE_TYPES = ("CONFIDENTIALITY", "ASSIGNMENT", "TERMINATION")


RISK_RULES = (  # fixed example rule table for the C9 extension
    ("TERMINATION_NOTICE", "Termination needs written notice", "medium", "(?i)written notice"),
    ("LIABILITY_CAP", "Liability is capped", "high", "(?i)liability .* capped"),
    ("ASSIGNMENT_BAN", "Assignment is restricted", "low", "(?i)may not assign"),
)


def annotated_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CUAD-shaped rows from the contract view: (doc_id, text, annotations)
    with a PARTY span at the customer name, a DATE span at the agreement
    date, a clause type by K % 3 (absent when K % 10 = 9) and a summary =
    the agreement line."""
    from pyspark.sql import functions as F

    cv = contract_view(spark, sf_dir)
    k = F.col("doc_id")
    date = F.concat_ws("/", F.month("modified_at").cast("string"), F.dayofmonth("modified_at").cast("string"),
                       F.year("modified_at").cast("string"))
    ps = (F.instr("text", F.col("c_name")) - 1).cast("int")
    ds = (F.instr("text", date) - 1).cast("int")
    none_s, none_i = F.lit(None).cast("string"), F.lit(None).cast("int")

    def ann(entity, start, end, label, ctype, summ):
        return F.struct(entity.alias("entity"), start.alias("start"), end.alias("end"),
                        label.alias("label"), ctype.alias("clause_type"), summ.alias("summary"))

    ctype = F.element_at(F.array(*[F.lit(c) for c in FIXTURE_CLAUSE_TYPES]), (k % 3 + 1).cast("int"))
    line2 = F.concat(F.lit("Signed on "), date, F.lit(" as an agreement of the houses named below."))
    empty = F.expr("CAST(array() AS array<struct<entity:string,start:int,end:int,label:string,"
                   "clause_type:string,summary:string>>)")
    anns = F.concat(
        F.array(ann(F.col("c_name"), ps, (ps + F.length("c_name")).cast("int"), F.lit("PARTY"), none_s, none_s),
                ann(date, ds, (ds + F.length(date)).cast("int"), F.lit("DATE"), none_s, none_s)),
        F.when(k % 10 != 9, F.array(ann(none_s, none_i, none_i, none_s, ctype, none_s))).otherwise(empty),
        F.array(ann(none_s, none_i, none_i, none_s, none_s, line2)))
    return cv.select("doc_id", "text", anns.alias("annotations"))


def predicted_spans(gold: DataFrame) -> DataFrame:
    """Predictions for A2/A3: gold spans, end shifted by one when
    K % 5 = 0, dropped when K % 11 = 0."""
    from pyspark.sql import functions as F

    k = F.col("doc_id")
    return gold.filter(k % 11 != 0).withColumn(
        "end", F.when(k % 5 == 0, F.col("end") + 1).otherwise(F.col("end")).cast("int"))


def conversation_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as paragraphs: conv_id = document, turn = order;
    heading when role = 'system' or turn % 4 = 0 (more headings)."""
    from pyspark.sql import functions as F

    from clauselake.sources.tables import table

    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("para_no"), "text",
                    ((F.col("role") == "system") | (F.col("turn") % 4 == 0)).alias("is_heading"))
