"""C9 with a rule table: thousands of user rules (type, description, severity,
pattern) against all sections.

A theta join on RLIKE would try every rule on every section.  Instead the
literals that a pattern cannot match without are read off it, each rule is
indexed under its rarest one (``gram_index``), and RLIKE is tried on sections that
contain that literal only.  A pattern from which no literal can be read with
certainty (alternatives at the top, only classes or groups, Unicode case folding,
literals under ``LEAST`` characters) goes the plain way: those rules become
literals of one narrow plan, one RLIKE for each section and rule, as no index can
spare them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.operators.classify import RISK_TYPE
from clauselake.operators.gram_index import BROADCAST_BYTES, occurrences
from clauselake.session import ship_package, work_dir

RULE = ["type", "description", "severity", "pattern"]
#: Shortest literal that is worth an index entry.
LEAST = 3
_PLAIN_ESCAPES = "bBdDsSwWAzZGhHvVRtnrfea"


def _past(p: str, i: int, close: str) -> int:
    """Place behind the class or group that opens at ``i``; -1 if unsure."""
    if close == "]":
        i += 2 if p[i + 1 : i + 2] == "^" else 1
        if p[i : i + 1] == "]":
            return -1
        while i < len(p) and p[i] != "]":
            if p[i] in "[&":
                return -1  # nested or intersected classes
            i += 2 if p[i] == "\\" else 1
        return i + 1 if i < len(p) else -1
    i += 1
    while i < len(p) and p[i] != ")":
        if p[i] in "[(":
            i = _past(p, i, "]" if p[i] == "[" else ")")
            if i < 0:
                return -1
        else:
            i += 2 if p[i] == "\\" else 1
    return i + 1 if i < len(p) else -1


def required_literals(pattern: str) -> list[str]:
    """Lower-cased strings of ``LEAST`` characters or more that every match of
    ``pattern`` holds; none where that is not certain."""
    return [r for r in _runs(pattern) if len(r) >= LEAST]


def _runs(pattern: str) -> list[str]:
    """Such strings of any length."""
    runs, run, i = [], "", 0

    def end():
        nonlocal run
        if run:
            runs.append(run)
        run = ""

    while i < len(pattern):
        c = pattern[i]
        atom = None  # a single literal character that a quantifier may follow
        if c == "(":
            flags = re.match(r"\(\?([a-zA-Z]*)(-[a-zA-Z]+)?[:)]", pattern[i:])
            if flags and set(flags[1]) & set("xuU"):
                return []
            end()
            i = _past(pattern, i, ")")
        elif c == "[":
            end()
            i = _past(pattern, i, "]")
        elif c == "|":
            return []
        elif c == "\\":
            nxt = pattern[i + 1 : i + 2]
            if nxt in ("p", "P") and pattern[i + 2 : i + 3] == "{":
                end()
                i = pattern.find("}", i) + 1 or -1
            elif nxt and not nxt.isalnum() and nxt.isascii():
                atom, i = nxt, i + 2
            elif nxt and nxt in _PLAIN_ESCAPES:
                end()
                i += 2
            else:
                return []
        elif c in ".^$":
            end()
            i += 1
        elif c in "*+?{":
            return []  # nothing that it could repeat, or a flavour not known here
        else:
            i += 1
            if c.isascii():
                atom = c
            else:
                end()
        if i < 0:
            return []
        many = re.match(r"([*+?]|\{(\d+)(,\d*)?\})[?+]?", pattern[i:])
        if pattern[i : i + 1] == "{" and not many:
            return []
        if many:
            i += len(many[0])
            if atom is not None and (many[1] == "+" or many[2] and int(many[2]) > 0):
                run += atom
            end()
        elif atom is not None:
            run += atom
    end()
    return [r.lower() for r in runs]


def _with_literals(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for t in tables:
        yield t.assign(literals=[required_literals(p) for p in t["pattern"]], runs=[sorted(set(_runs(p))) for p in t["pattern"]])


def rule_hits(sections: DataFrame, rules: DataFrame, id_cols: tuple[str, ...] = ("doc_id", "sec_no"), text: str = "text",
              broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(``id_cols``, type, description, severity, pattern) for each section and
    rule whose pattern is found in it.  Rules without a pattern are dropped,
    repeated ones taken once."""
    spark = sections.sparkSession
    ship_package(spark)
    path = f"{work_dir(spark, 'rules')}/rules"
    schema = ", ".join(f"{c} string" for c in RULE) + ", literals array<string>, runs array<string>"
    rules.select(*RULE).filter(F.col("pattern").isNotNull()).distinct().mapInPandas(_with_literals, schema).write.parquet(path)
    table = spark.read.parquet(path)
    rows = sections.select(*id_cols, F.col(f"`{text}`").alias("_section"))
    indexed = table.filter(F.size("literals") > 0).select(*RULE, "runs", F.explode("literals").alias("_literal"))
    hits = occurrences(rows, indexed, id_cols, "_section", "_literal", per=RULE, broadcast_bytes=broadcast_bytes)
    # a pattern of a table is compiled for each candidate: those without all its literals are left out first
    hits = hits.filter(F.forall("runs", lambda x: F.contains(F.lower("_section"), x)))
    hits = hits.filter(F.rlike(F.col("_section"), F.col("pattern"))).select(*id_cols, *RULE)
    plain = table.filter(F.size("literals") == 0).select(*RULE).collect()  # literals of the plan below
    if not plain:
        return hits
    found = F.array(*[F.when(F.col("_section").rlike(r.pattern), F.struct(*[F.lit(r[c]).cast("string").alias(c) for c in RULE])) for r in plain])
    return hits.unionByName(rows.select(*id_cols, F.inline(F.filter(found, lambda x: x.isNotNull()))))


def table_risks(docs: DataFrame, sections: DataFrame, rules: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, risks) for every row of ``docs``: hits of its ``sections`` (doc_id,
    sec_no, text), ordered by the first section hit, then by type, description and
    severity; no hit gives the empty list."""
    hits = rule_hits(sections, rules, broadcast_bytes=broadcast_bytes)
    firsts = hits.groupBy("doc_id", *RULE[:3]).agg(F.min("sec_no").alias("first_sec"))
    lists = firsts.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("first_sec", *RULE[:3]))).alias("_hits"))
    risks = F.transform("_hits", lambda h: F.struct(*[h[c].alias(c) for c in RULE[:3]]))
    return docs.select("doc_id").join(lists, "doc_id", "left").select(
        "doc_id", F.coalesce(risks, F.expr(f"CAST(array() AS {RISK_TYPE})")).alias("risks"))
