"""DuckDB oracle SQL, one text per registered query.

Written relationally (unnest, window functions, group by), independently
of the Spark plans (which work per document with higher-order functions);
shares only the fixed values of ``vocab`` and the fixture texts.  Tables
are the driver's pre-registered views.
"""

from __future__ import annotations

from clauselake import vocab as V
from clauselake.plans.sqlparts import (ENTITY_ALT, PARTY_ALT, WORDCH, WS, clean_app, clean_basic,
                                       clean_summary, contains_count, doc_type, ellipsize, fix_punct, iso,
                                       ordered_distinct, q, qlist, re2, section_type, sents, strip, wc)
from clauselake.sources.fixtures import CLOSING_TYPES, FIXTURE_CLAUSE_TYPES, RISK_RULES, contract_view_sql

CONTRACTS = (f"(SELECT doc_id, filename, text, cust_key, c_name, modified_at, intended_type, "
             f"CAST(strlen(text) AS BIGINT) AS file_size FROM ({contract_view_sql()}) cv)")
DOCUMENTS = "(SELECT doc_id, text FROM documents)"
ANALYZED_AT = "2024-01-01T00:00:00"
STOP = qlist(V.ENGLISH_STOP_WORDS)
STOP_ALL = qlist(list(V.ENGLISH_STOP_WORDS) + list(V.LEGAL_STOP_WORDS))


def _values(rows) -> str:
    def lit(v):
        if isinstance(v, str):
            return q(v)
        if isinstance(v, float):
            return f"{v!r}::DOUBLE"
        return str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + ")"


# --- segmentation ------------------------------------------------------------
def sentences_sql(src: str) -> str:
    return f"""SELECT doc_id, CAST(unnest(range(len(ss))) AS INTEGER) AS pos, unnest(ss) AS sentence
FROM (SELECT doc_id, {sents('text')} AS ss FROM {src} x) y"""


def paragraphs_sql(src: str, sep: str = "chr(10) || chr(10)") -> str:
    t, c = section_type("p")
    return f"""SELECT doc_id, sec_no, {ellipsize('p', 50)} AS title, p AS text, {t} AS type, {c} AS confidence
FROM (SELECT doc_id, CAST(unnest(range(len(ps))) AS INTEGER) AS sec_no, unnest(ps) AS p
      FROM (SELECT doc_id, list_filter(list_transform(string_split(text, {sep}), lambda z: {strip('z')}),
                                       lambda z: z <> '') AS ps FROM {src} x) y) z"""


def groups_sql(src: str, from_sents: str | None = None) -> str:
    """G3; ``from_sents`` gives other sentences (doc_id, pos, sentence) than G1's."""
    return f"""SELECT doc_id, CAST(pos // 3 AS INTEGER) AS sec_no,
  CASE WHEN pos // 3 = 0 THEN 'Document Content' ELSE 'Section ' || CAST(pos // 3 + 1 AS VARCHAR) END AS title,
  string_agg(sentence, ' ' ORDER BY pos) AS text, 'CONTENT_SECTION' AS type, 0.8::DOUBLE AS confidence
FROM ({from_sents or sentences_sql(src)}) s GROUP BY doc_id, pos // 3"""


def whole_sql(src: str) -> str:
    return f"""SELECT doc_id, 0 AS sec_no, 'Document Content' AS title, {ellipsize('text', 1000)} AS text,
  'CONTENT_SECTION' AS type, 1.0::DOUBLE AS confidence FROM {src} w"""


def clauses_sql(src: str) -> str:
    """G2, else G3, else G4 (the analyser's section pipeline)."""
    return f"""WITH p AS ({paragraphs_sql(src)}),
g AS ({groups_sql(src)}),
pg AS (SELECT * FROM p UNION ALL SELECT * FROM g WHERE doc_id NOT IN (SELECT doc_id FROM p))
SELECT * FROM pg UNION ALL
SELECT * FROM ({whole_sql(src)}) w WHERE doc_id NOT IN (SELECT doc_id FROM pg)"""


def header_title(line: str) -> str:
    s = strip(line)
    arms = " ".join(f"WHEN regexp_matches({s}, {q(re2(p))}) THEN {strip(f'regexp_extract({s}, {q(re2(p))}, 1)')}"
                    for p in V.SECTION_HEADER_PATTERNS)
    return f"(CASE {arms} END)"


def g5_sql(src: str) -> str:
    return f"""WITH l AS (SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {src} x) y),
t AS (SELECT doc_id, line_no, line, {header_title('line')} AS title FROM l),
s AS (SELECT *, sum(CASE WHEN title IS NOT NULL THEN 1 ELSE 0 END)
        OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS sec FROM t)
SELECT doc_id, CAST(sec - 1 AS INTEGER) AS sec_no, arg_min(title, line_no) AS title,
  {strip("string_agg(line, chr(10) ORDER BY line_no)")} AS text
FROM s WHERE sec > 0 GROUP BY doc_id, sec"""


CONV_PARAS = ("(SELECT conv_id AS doc_id, turn AS para_no, text, (role = 'system' OR turn % 4 = 0) AS is_heading "
              "FROM conversations)")


def g6_sql() -> str:
    return f"""WITH p AS (SELECT * FROM {CONV_PARAS} c WHERE {strip('text')} <> ''),
h AS (SELECT *, sum(CAST(is_heading AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY para_no
        ROWS UNBOUNDED PRECEDING) AS sec,
        max(CAST(is_heading AS INTEGER)) OVER (PARTITION BY doc_id) AS has FROM p),
a AS (SELECT doc_id, CAST(sec - 1 AS INTEGER) AS sec_no, {strip('arg_min(text, para_no)')} AS title,
        {strip("string_agg(text, chr(10) ORDER BY para_no)")} AS text
      FROM h WHERE has = 1 AND sec > 0 GROUP BY doc_id, sec),
nh AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY para_no) AS text FROM h WHERE has = 0 GROUP BY doc_id)
SELECT * FROM a UNION ALL SELECT * FROM ({g5_sql('nh')}) f"""


# --- entities ----------------------------------------------------------------
def spans_sql(src: str, pattern: str) -> str:
    """All matches with offsets: gaps from a split, starts from a running
    sum over (gap + match) lengths."""
    return f"""SELECT doc_id, text, CAST(ord AS INTEGER) AS ord, m,
  CAST(sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING)
       - length(m) AS INTEGER) AS start
FROM (SELECT doc_id, text, unnest(range(len(ms))) AS ord, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g
      FROM (SELECT doc_id, text, regexp_extract_all(text, {q(pattern)}) AS ms,
                   regexp_split_to_array(text, {q(pattern)}) AS gs FROM {src} x) y) z"""


def entity_label(m: str) -> str:
    arms = " ".join(f"WHEN regexp_full_match({m}, {q(p)}) THEN {q(lab)}" for lab, p in V.PATTERN_ENTITY_RULES)
    return f"(CASE {arms} END)"


def context(text: str, start: str, end: str) -> str:
    lo = f"greatest({start} - 50, 0)"
    return f"substr({text}, {lo} + 1, greatest(least(length({text}), {end} + 50) - {lo}, 0))"


def e1_sql(src: str) -> str:
    return f"""SELECT doc_id, ord, m AS text, {entity_label('m')} AS label, start,
  CAST(start + length(m) AS INTEGER) AS "end", {context('text', 'start', 'start + length(m)')} AS context
FROM ({spans_sql(src, ENTITY_ALT)}) s"""


GAZETTEER = _values([("structure", i, t, lab, V.STRUCTURE_CONTEXT) for i, (t, lab) in enumerate(V.STRUCTURE_TERMS)]
                    + [("format", i, t, lab, V.FORMAT_CONTEXT) for i, (t, lab) in enumerate(V.FORMAT_TERMS)])


def gazetteer_sql(src: str) -> str:
    return f"""SELECT c.doc_id, t.source, CAST(t.ord AS INTEGER) AS ord, t.term AS text, t.label, t.context
FROM {src} c, {GAZETTEER} t(source, ord, term, label, context)
WHERE contains(lower(c.text), lower(t.term))"""


def legal_regex() -> str:
    alts = "|".join(t.replace(" ", f"{WS}+") for t in V.LEGAL_TERMS)
    return rf"(?i)\b(?:{alts})\b"


def legal_sql(src: str) -> str:
    """E1 + E4 (legal terms that do not overlap an E1 span)."""
    return f"""WITH e1 AS ({e1_sql(src)}),
l AS ({spans_sql(src, legal_regex())})
SELECT doc_id, 'ner' AS source, ord, text, label, start, "end",
  least(0.5::DOUBLE + len(regexp_split_to_array(text, {q(WS + '+')})) * 0.1::DOUBLE, 0.9::DOUBLE) AS confidence FROM e1
UNION ALL
SELECT l.doc_id, 'legal', l.ord, l.m, 'LEGAL_TERM', l.start, CAST(l.start + length(l.m) AS INTEGER),
  least(0.5::DOUBLE + len(regexp_split_to_array(l.m, {q(WS + '+')})) * 0.1::DOUBLE, 0.9::DOUBLE)
FROM l WHERE NOT EXISTS (SELECT 1 FROM e1 WHERE e1.doc_id = l.doc_id AND e1.start < l.start + length(l.m)
                         AND l.start < e1."end")"""


def cue_sql(src: str) -> str:
    toks = r"regexp_extract_all(lower(s), '([\p{L}\p{N}]+)', 1)"
    return f"""WITH s AS (SELECT doc_id, unnest(range(len(ss))) AS i, unnest(ss) AS s
  FROM (SELECT doc_id, ({sents('text')})[1:5] AS ss FROM {src} x) y)
SELECT doc_id, CAST(i * 2 AS INTEGER) AS ord, 'Introduction' AS text, s AS context FROM s
  WHERE list_has_any({toks}, {qlist(V.INTRO_CUES)})
UNION ALL
SELECT doc_id, CAST(i * 2 + 1 AS INTEGER), 'Conclusion', s FROM s
  WHERE list_has_any({toks}, {qlist(V.CONCLUSION_CUES)})"""


def all_entities_sql(src: str) -> str:
    """E7 (+E6 defaults): doc_id, source, ord, text, label, confidence, src_rank."""
    defaults = _values([(i, t, lab, c) for i, (t, lab, c, _) in enumerate(V.DEFAULT_ENTITIES)])
    return f"""WITH e AS (
  SELECT doc_id, 'ner' AS source, ord, text, label, 0.9::DOUBLE AS confidence, 0 AS src_rank FROM ({e1_sql(src)}) a
  UNION ALL SELECT doc_id, source, ord, text, label, 0.8::DOUBLE,
    CASE source WHEN 'structure' THEN 1 ELSE 2 END FROM ({gazetteer_sql(src)}) b
  UNION ALL SELECT doc_id, 'cue', ord, text, 'SECTION_TYPE', 0.7::DOUBLE, 3 FROM ({cue_sql(src)}) c)
SELECT * FROM e
UNION ALL
SELECT d.doc_id, 'default', CAST(t.ord AS INTEGER), t.text, t.label, t.conf, 4
FROM {src} d, {defaults} t(ord, text, label, conf)
WHERE d.doc_id NOT IN (SELECT doc_id FROM e)"""


# --- summaries ---------------------------------------------------------------
def m1_sql(src: str, ss: str | None = None) -> str:
    """M1 + M4 + M6-M8 over ``src`` (doc_id, text, and its sentences in a column
    ``ss`` where they are other than G1's)."""
    h = contains_count("lower(s)", V.IMPORTANT_TERMS)
    w = wc("s")
    dates = f"regexp_extract_all(text, {q(V.DATE_PATTERN)})"
    ents = ordered_distinct(f"regexp_extract_all(substr(text, 1, 1000), {q(PARTY_ALT)})[1:5]")
    return f"""
WITH docs AS (SELECT doc_id, text{', ' + ss if ss else ''} FROM {src} src),
base AS (
  SELECT doc_id, text, list_filter({ss or sents('text')}, lambda z: {wc('z')} > 3) AS kept FROM docs),
ks AS (
  SELECT doc_id, unnest(kept) AS s, unnest(range(len(kept))) AS i, len(kept) AS n FROM base),
sc AS (
  SELECT doc_id, s, i, n,
    ((CASE WHEN i < n * 0.1::DOUBLE THEN 1.5::DOUBLE WHEN i > n * 0.9::DOUBLE THEN 1.3::DOUBLE
           ELSE 1.0::DOUBLE END)
     * (CASE WHEN {w} BETWEEN 10 AND 30 THEN 1.2::DOUBLE WHEN {w} > 30 THEN 0.8::DOUBLE
             ELSE 1.0::DOUBLE END))
     * (1.0::DOUBLE + list_reduce(list_prepend(0.0::DOUBLE,
            list_transform(range({h}), lambda x: 0.1::DOUBLE)), lambda a, b: a + b)) AS score
  FROM ks),
rk AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS r,
         min(i) OVER (PARTITION BY doc_id, s) AS first_i,
         least(greatest(CAST(floor(n * 0.2::DOUBLE) AS INTEGER), 3), 10) AS k
  FROM sc),
sel AS (
  SELECT doc_id, {fix_punct("string_agg(s, ' ' ORDER BY first_i, r)")} AS stext, max(n) AS n
  FROM rk WHERE r <= k GROUP BY doc_id),
st AS (
  SELECT b.doc_id, b.text, b.kept, s.stext, s.n, {wc('b.text')} AS orig, {wc('s.stext')} AS slen,
         {doc_type('b.text')} AS dtype
  FROM base b LEFT JOIN sel s ON b.doc_id = s.doc_id),
st2 AS (
  SELECT *, CASE WHEN orig > 0 THEN slen::DOUBLE / orig ELSE 0.0 END AS ratio FROM st),
fb AS (
  SELECT *, CASE WHEN slen < 10 OR ratio < 0.1 THEN concat_ws(chr(10),
      CASE WHEN {wc('kept[1]')} <= 15 THEN 'Title: ' || kept[1] END,
      CASE WHEN len({dates}) > 0 THEN 'Dates mentioned: ' || array_to_string(({dates})[1:3], ', ') END,
      CASE WHEN len({ents}) > 0 THEN 'Key entities: ' || array_to_string({ents}, ', ') END,
      'Document length: ' || CAST(orig AS VARCHAR) || ' words',
      'Number of sentences: ' || CAST(n AS VARCHAR)) END AS fallback
  FROM st2)
SELECT doc_id,
  CASE WHEN text IS NULL OR {strip('text')} = '' THEN {q(V.EMPTY_SUMMARY)}
       WHEN stext IS NULL THEN {q(V.NO_SENTENCE_SUMMARY)}
       ELSE 'This ' || dtype || ' contains the following key points:' || chr(10) || chr(10) || stext
            || CASE WHEN fallback IS NULL THEN ''
                    ELSE chr(10) || chr(10) || 'Additional Information:' || chr(10) || fallback END
  END AS summary,
  CAST(CASE WHEN text IS NULL OR {strip('text')} = '' THEN 0 ELSE orig END AS INTEGER) AS original_length,
  CAST(CASE WHEN stext IS NULL THEN 0 ELSE slen END AS INTEGER) AS summary_length,
  round(CASE WHEN stext IS NULL THEN 0.0 ELSE ratio END, 6) AS compression_ratio,
  CASE WHEN stext IS NULL THEN 0.0 ELSE ratio END AS raw_ratio,
  CASE WHEN text IS NULL OR {strip('text')} = '' THEN 'empty document'
       WHEN stext IS NULL THEN 'document' ELSE dtype END AS document_type,
  CASE WHEN text IS NULL OR {strip('text')} = '' THEN 'error'
       WHEN stext IS NULL THEN 'ok' ELSE 'success' END AS status,
  CASE WHEN text IS NULL OR {strip('text')} = '' THEN {q(V.EMPTY_FALLBACK)}
       WHEN stext IS NULL THEN {q(V.NO_SENTENCE_FALLBACK)} ELSE fallback END AS fallback_summary
FROM fb
"""


def m1_out(src: str, ss: str | None = None) -> str:
    return f"""SELECT doc_id, summary, original_length, summary_length, compression_ratio, document_type, status,
  fallback_summary FROM ({m1_sql(src, ss)}) m"""


def short_summary(s: str) -> str:
    short = strip(f"array_to_string(string_split({s}, '.')[1:2], ' ')")
    return f"(CASE WHEN {short} <> '' THEN {short} ELSE {s} END)"


def m2_sql(src: str, from_sents: str | None = None) -> str:
    weights = "[" + ", ".join(f"{{'t': {q(t)}, 'w': {w!r}::DOUBLE}}" for t, w in V.LEGAL_WEIGHTS) + "]"
    header = " OR ".join(f"regexp_matches({strip('s')}, {q(re2(p))})" for p in V.SUMMARY_HEADER_PATTERNS)
    base = (f"list_reduce(list_prepend(1.0::DOUBLE, list_transform(list_filter({weights}, "
            f"lambda x: contains(lower(s), x.t)), lambda x: x.w)), lambda a, b: a + b)")
    return f"""WITH s AS (SELECT doc_id, pos, sentence AS s FROM ({from_sents or sentences_sql(src)}) z),
sc AS (SELECT doc_id, pos, s,
  (CASE WHEN {header} THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END) *
  (CASE WHEN {wc('s')} > 30 THEN ({base}) * 0.8::DOUBLE ELSE ({base}) END) AS score FROM s),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS r,
         min(pos) OVER (PARTITION BY doc_id, s) AS first_i FROM sc),
sel AS (SELECT doc_id, string_agg(s, ' ' ORDER BY first_i, r) AS summary FROM rk WHERE r <= 5 GROUP BY doc_id),
j AS (SELECT d.doc_id, coalesce(sel.summary, '') AS summary, {wc('d.text')} AS orig
      FROM {src} d LEFT JOIN sel ON d.doc_id = sel.doc_id)
SELECT doc_id, summary, CAST(orig AS INTEGER) AS original_length, CAST({wc('summary')} AS INTEGER) AS summary_length,
  round(CASE WHEN orig > 0 THEN {wc('summary')}::DOUBLE / orig ELSE 0.0 END, 6) AS compression_ratio,
  {q(','.join(t for t, _ in V.LEGAL_WEIGHTS))} AS key_terms
FROM j"""


def m3_sql(src: str, max_length: int = 150, max_features: int = 10_000) -> str:
    toks = (f"list_filter(regexp_extract_all(lower(s), '([\\p{{L}}\\p{{N}}_]{{2,}})', 1), "
            f"lambda t: NOT list_contains({STOP}, t))")
    return f"""WITH b AS (SELECT doc_id, text, {clean_summary('text')} AS clean FROM {src} x),
c AS (SELECT doc_id, text, clean, {sents('clean')} AS ss FROM b),
short AS (SELECT doc_id,
    CASE WHEN text IS NULL OR {strip('text')} = '' THEN '' ELSE clean END AS summary,
    CAST(CASE WHEN text IS NULL OR {strip('text')} = '' THEN 0 ELSE len(ss) END AS INTEGER) AS original_length,
    CAST(CASE WHEN text IS NULL OR {strip('text')} = '' THEN 0 ELSE len(ss) END AS INTEGER) AS summary_length,
    CASE WHEN text IS NULL OR {strip('text')} = '' THEN 0.0 ELSE 1.0 END AS compression_ratio
  FROM c WHERE text IS NULL OR {strip('text')} = '' OR len(ss) <= {max_length}),
longd AS (SELECT doc_id, ss, len(ss) AS n FROM c WHERE NOT (text IS NULL OR {strip('text')} = '')
  AND len(ss) > {max_length}),
s AS (SELECT doc_id, n, unnest(range(len(ss))) AS pos, unnest(ss) AS s FROM longd),
tk AS (SELECT doc_id, n, pos, s, {toks} AS t FROM s),
terms AS (SELECT doc_id, n, pos, unnest(list_concat(t, list_transform(range(1, len(t)),
            lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM tk),
tf AS (SELECT doc_id, n, pos, term, count(*) AS tf FROM terms GROUP BY doc_id, n, pos, term),
st AS (SELECT *, count(*) OVER (PARTITION BY doc_id, term) AS df, sum(tf) OVER (PARTITION BY doc_id, term) AS total
       FROM tf),
vr AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY total DESC, term) AS vrank FROM st),
w AS (SELECT doc_id, pos, tf * (ln((n + 1)::DOUBLE / (df + 1)) + 1) AS w FROM vr WHERE vrank <= {max_features}),
sc AS (SELECT doc_id, pos, sum(w) / sqrt(sum(w * w)) AS score FROM w GROUP BY doc_id, pos),
alls AS (SELECT s.doc_id, s.pos, s.s, s.n, coalesce(sc.score, 0.0) AS score
         FROM s LEFT JOIN sc ON s.doc_id = sc.doc_id AND s.pos = sc.pos),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos DESC) AS r FROM alls),
picked AS (SELECT doc_id, string_agg(s, ' ' ORDER BY pos) AS summary, CAST(max(n) AS INTEGER) AS original_length,
    CAST(count(*) AS INTEGER) AS summary_length, count(*)::DOUBLE / max(n) AS compression_ratio
  FROM rk WHERE r <= {max_length} GROUP BY doc_id)
SELECT doc_id, summary, original_length, summary_length, round(compression_ratio, 6) AS compression_ratio FROM short
UNION ALL
SELECT doc_id, summary, original_length, summary_length, round(compression_ratio, 6) FROM picked"""


def m5_sql(src: str, k: int = 10) -> str:
    toks = (f"list_filter(regexp_extract_all(lower(text), '([\\p{{L}}\\p{{N}}]+)', 1), "
            f"lambda t: NOT list_contains({STOP_ALL}, t))")
    return f"""WITH t AS (SELECT doc_id, {toks} AS ts FROM {src} x),
u AS (SELECT doc_id, unnest(ts) AS w, unnest(range(len(ts))) AS p FROM t),
c AS (SELECT doc_id, w, count(*) AS freq, min(p) AS first FROM u GROUP BY doc_id, w),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY freq DESC, first) AS rank FROM c)
SELECT doc_id, CAST(rank AS INTEGER) AS rank, w AS phrase, CAST(freq AS INTEGER) AS freq FROM r WHERE rank <= {k}"""


# --- fixtures ----------------------------------------------------------------
DATE_STR = ("CAST(month(modified_at) AS VARCHAR) || '/' || CAST(day(modified_at) AS VARCHAR) || '/' || "
            "CAST(year(modified_at) AS VARCHAR)")


def gold_sql() -> str:
    """D1 spans of the annotated fixture: PARTY at c_name, DATE at the
    agreement date."""
    return f"""SELECT doc_id, CAST(instr(text, c_name) - 1 AS INTEGER) AS start,
  CAST(instr(text, c_name) - 1 + length(c_name) AS INTEGER) AS "end", 'PARTY' AS label, 0 AS o FROM {CONTRACTS} a
UNION ALL
SELECT doc_id, CAST(instr(text, {DATE_STR}) - 1 AS INTEGER),
  CAST(instr(text, {DATE_STR}) - 1 + length({DATE_STR}) AS INTEGER), 'DATE', 1 FROM {CONTRACTS} b"""


def pred_sql() -> str:
    return f"""SELECT doc_id, start, CAST(CASE WHEN doc_id % 5 = 0 THEN "end" + 1 ELSE "end" END AS INTEGER) AS "end",
  label FROM ({gold_sql()}) g WHERE doc_id % 11 <> 0"""


def ctype_sql(k: str) -> str:
    return f"CASE WHEN {k} % 10 = 9 THEN NULL ELSE {qlist(FIXTURE_CLAUSE_TYPES)}[{k} % 3 + 1] END"


LINE2 = f"'Signed on ' || {DATE_STR} || ' as an agreement of the houses named below.'"


# --- analysis (X1) -----------------------------------------------------------
def admission(filename: str = "filename", size: str = "file_size", text: str = "text") -> str:
    suffix = f"lower(regexp_extract({filename}, '\\.([^./]*)$', 1))"
    return f"""(CASE WHEN {filename} IS NULL OR {size} IS NULL THEN 'missing'
  WHEN {size} = 0 THEN 'empty_file' WHEN {size} > {V.MAX_FILE_BYTES} THEN 'too_large'
  WHEN {suffix} NOT IN ({', '.join(q(s) for s in V.ALLOWED_SUFFIXES)}) THEN 'unsupported_type'
  WHEN {text} IS NULL OR {strip(text)} = '' THEN 'no_text'
  WHEN {wc(text)} < {V.MIN_WORDS} THEN 'too_short' END)"""


DOCS_AS_CONTRACTS = ("(SELECT doc_id, 'doc_' || CAST(doc_id AS VARCHAR) || '.' || ['pdf', 'docx', 'txt'][doc_id % 3 + 1] "
                     "AS filename, text, CAST(strlen(text) AS BIGINT) AS file_size, "
                     "CAST(NULL AS TIMESTAMP) AS modified_at FROM documents)")


def analysis_sql(base: str = CONTRACTS) -> str:
    """X1 per admitted document: counts and texts of every sub-result."""
    text = f"CASE WHEN lower(filename) LIKE '%.pdf' THEN {clean_app('text')} ELSE {strip('text')} END"
    src = f"(SELECT * REPLACE ({text} AS text) FROM {base} c0 WHERE {admission()} IS NULL)"
    return f"""WITH e AS ({all_entities_sql(src)}),
ea AS (SELECT doc_id, count(*) AS n_entities, count(DISTINCT label) AS n_labels,
         count(*) FILTER (WHERE confidence >= 0.7) AS n_ent_thr, avg(confidence) AS avg_conf FROM e GROUP BY doc_id),
s AS ({clauses_sql(src)}),
sa AS (SELECT doc_id, count(*) AS n_sections, string_agg(type, '|' ORDER BY sec_no) AS section_types,
         count(*) FILTER (WHERE confidence >= 0.7) AS n_clauses FROM s GROUP BY doc_id),
m AS ({m1_sql(src)})
SELECT c.doc_id, c.filename, regexp_extract(c.filename, '\\.([^./]*)$', 1) AS file_type, c.text, c.modified_at,
  c.file_size, m.document_type, m.status, m.summary, m.original_length, m.summary_length, m.compression_ratio,
  m.raw_ratio, CAST(ea.n_entities AS INTEGER) AS n_entities, CAST(ea.n_labels AS INTEGER) AS n_entity_labels,
  CAST(ea.n_ent_thr AS INTEGER) AS n_ent_thr, ea.avg_conf,
  CAST(sa.n_sections AS INTEGER) AS n_sections, sa.section_types, CAST(sa.n_clauses AS INTEGER) AS n_clauses,
  array_to_string(list_filter({sents('c.text')}, lambda z: {wc('z')} > 5)[1:3], '|') AS key_points,
  {short_summary('m.summary')} AS short_summary,
  concat_ws('|', CASE WHEN ea.n_labels < 5 THEN {q(V.WARN_ENTITIES)} END,
                 CASE WHEN sa.n_sections < 3 THEN {q(V.WARN_SECTIONS)} END,
                 CASE WHEN m.raw_ratio < 0.1 THEN {q(V.WARN_SUMMARY)} END) AS warnings
FROM {src} c JOIN ea ON c.doc_id = ea.doc_id JOIN sa ON c.doc_id = sa.doc_id JOIN m ON c.doc_id = m.doc_id"""


def x1_sql(base: str = CONTRACTS) -> str:
    return f"""SELECT doc_id, filename, file_type, document_type, status, summary, original_length, summary_length,
  compression_ratio, n_entities, n_entity_labels, n_sections, section_types, key_points, short_summary, warnings,
  0 AS n_risks, 'success' AS analysis_status FROM ({analysis_sql(base)}) a"""


def metadata_values_sql(alias: str = "a") -> str:
    """The metadata map's values of a contract (S2 fields)."""
    fn = f"{alias}.filename"
    stem = f"regexp_replace({fn}, '\\.[^./]*$', '')"
    d = iso(f"{alias}.modified_at")
    return (f"[{fn}, CAST({alias}.file_size AS VARCHAR), {d}, {d}, "
            f"upper(regexp_extract({fn}, '\\.([^./]*)$', 1)), {stem}, 'Unknown', {d}]")


# --- the oracle table --------------------------------------------------------
def oracle_sql() -> dict[str, str]:
    C, D = CONTRACTS, DOCUMENTS
    sec_cols = "doc_id, sec_no, title, text, type, confidence"
    o = {}
    # sources
    o["s1_scan_documents"] = "SELECT doc_id, lang, n_chars FROM documents"
    dac = ("(SELECT doc_id, 'doc_' || CAST(doc_id AS VARCHAR) || '.' || ['pdf', 'docx', 'txt'][doc_id % 3 + 1] "
           "AS filename, text, CAST(strlen(text) AS BIGINT) AS file_size FROM documents)")
    o["s3_admission"] = f"SELECT doc_id, filename, {admission()} AS reason FROM {dac} d"
    o["s4_read_annotations"] = f"""SELECT doc_id, CAST(CASE WHEN doc_id % 10 = 9 THEN 3 ELSE 4 END AS INTEGER)
  AS n_annotations, {ctype_sql('doc_id')} AS clause_type, CAST(instr(text, c_name) - 1 AS INTEGER) AS party_start,
  md5(text) AS text_md5, g.spans, {LINE2} AS summaries
FROM {C} c JOIN (SELECT doc_id AS k, string_agg(CAST(start AS VARCHAR) || ':' || CAST("end" AS VARCHAR) || ':' || label, ',' ORDER BY o) AS spans
  FROM ({gold_sql()}) x GROUP BY doc_id) g ON g.k = c.doc_id"""
    o["s5_s6_dataset_roundtrip"] = f"""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' ||
  CAST(doc_id AS VARCHAR)), doc_id) <= ceil(0.2::DOUBLE * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split,
  text, g.spans
FROM {C} c JOIN (SELECT doc_id AS k, string_agg(CAST(start AS VARCHAR) || ':' || CAST("end" AS VARCHAR) || ':' || label, ',' ORDER BY o) AS spans
  FROM ({gold_sql()}) x GROUP BY doc_id) g ON g.k = c.doc_id"""
    o["s7_merge_store"] = f"""SELECT filename, {q(ANALYZED_AT)} AS analyzed_at,
  CASE WHEN doc_id % 9 = 0 THEN 'reloaded' ELSE regexp_extract(filename, '\\.([^./]*)$', 1) END AS file_type,
  CAST(CASE WHEN doc_id % 9 = 0 THEN 2 ELSE 1 END AS BIGINT) AS load_seq, n_entities, n_sections, document_type FROM ({analysis_sql()}) c"""
    o["s8_load_store"] = f"""SELECT filename, n_entities, n_sections, document_type,
  CAST(file_size AS VARCHAR) AS file_size FROM ({analysis_sql()}) a"""
    o["s9_metrics_roundtrip"] = f"SELECT label, round(f1, 6) AS f1 FROM ({a2_sql()}) a"
    o["s10_export_metadata"] = f"""SELECT doc_id, '{{"created_date":"' || {iso('modified_at')} ||
  '","modified_date":"' || {iso('modified_at')} || '"}}' AS metadata_json FROM {C} c"""
    o["s10_export_metadata_pretty"] = f"""SELECT doc_id, '{{' || chr(10) || '  "created_date": "' || {iso('modified_at')} || '",' || chr(10) ||
  '  "modified_date": "' || {iso('modified_at')} || '"' || chr(10) || '}}' AS metadata_json FROM {C} c"""
    o["s12_pages_to_text"] = f"SELECT page_id, url, {clean_basic(html_text('html'))} AS text FROM pages"
    squashed = f"trim(regexp_replace(coalesce(text, ''), {q(WS + '+')}, ' ', 'g'))"
    o["s12_join_pages"] = f"""SELECT conv_id AS doc_id, {clean_app("coalesce(string_agg(nullif(t, ''), ' ' ORDER BY turn), '')")} AS text
FROM (SELECT conv_id, turn, {squashed} AS t FROM conversations) x GROUP BY conv_id"""
    o["s7_store_save_load_search"] = f"""SELECT filename,
  CASE WHEN doc_id % 9 = 0 THEN 'reloaded' ELSE file_type END AS file_type, n_entities, n_sections, section_types, summary,
  CAST(file_size AS VARCHAR) AS file_size FROM ({analysis_sql()}) a
WHERE filename ILIKE '%7.pdf%' OR summary ILIKE '%7.pdf%' OR len(list_filter({metadata_values_sql('a')}, lambda v: v ILIKE '%7.pdf%')) > 0"""
    o["s13_assemble_pages"] = f"""SELECT conv_id AS doc_id, CAST(count(*) AS INTEGER) AS total_pages,
  string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id"""
    o["s14_assemble_paragraphs"] = f"""SELECT doc_id, string_agg(coalesce(text, ''), chr(10) ORDER BY para_no) AS text,
  CAST(count(*) AS INTEGER) AS total_paragraphs FROM {CONV_PARAS} p WHERE {strip('text')} <> ''
  GROUP BY doc_id"""
    o["s14_assemble_paragraphs_keep_blank"] = f"""SELECT doc_id,
  {strip("string_agg(coalesce(text, ''), chr(10) ORDER BY para_no)")} AS text,
  CAST(count(*) AS INTEGER) AS total_paragraphs FROM {CONV_PARAS} p
  GROUP BY doc_id"""
    o["s15_doc_properties"] = f"""SELECT doc_id,
  coalesce(CASE WHEN doc_id % 4 <> 0 THEN 'Contract ' || CAST(doc_id AS VARCHAR) END, '') AS title,
  coalesce(CASE WHEN doc_id % 3 <> 0 THEN c_name END, '') AS author,
  coalesce({iso('modified_at')}, '') AS created,
  coalesce(CASE WHEN doc_id % 5 <> 0 THEN {iso('modified_at')} END, '') AS modified,
  CAST(coalesce(CASE WHEN doc_id % 6 <> 0 THEN doc_id % 7 END, 0) AS INTEGER) AS revision,
  CAST(len(string_split(text, chr(10))) AS INTEGER) AS paragraph_count FROM {C} c"""
    o["s16_normalize_tables"] = f"""WITH t AS (
  SELECT l_orderkey AS k, count(*) AS n_rows,
    string_agg(CASE WHEN l_orderkey % 13 = 0 THEN ',,' ELSE CAST(l_linenumber AS VARCHAR) || ',' ||
      coalesce(l_returnflag, '') || ',' || coalesce(CASE WHEN l_linenumber % 3 <> 0 THEN l_linestatus END, '') END,
      ';' ORDER BY l_linenumber, l_returnflag NULLS FIRST,
      CASE WHEN l_linenumber % 3 <> 0 THEN l_linestatus END NULLS FIRST) AS cells
  FROM lineitem GROUP BY l_orderkey),
n AS (SELECT CAST(k // 10 AS BIGINT) AS doc_id, CAST((k % 10) // 4 + 1 AS INTEGER) AS page,
  CAST(row_number() OVER (PARTITION BY k // 10, (k % 10) // 4 ORDER BY k) AS INTEGER) AS table_number,
  CAST(n_rows AS INTEGER) AS n_rows, 3 AS n_columns, cells, k FROM t)
SELECT doc_id, page, table_number, n_rows, n_columns, cells FROM n WHERE k % 13 <> 0"""
    o["s16_normalize_tables_stripped"] = o["s16_normalize_tables"]
    o["s17_media_inventory"] = """SELECT page_id // 10 AS doc_id, CAST((page_id % 10) // 3 + 1 AS INTEGER) AS page, page_id AS blob_no,
  CAST(row_number() OVER (PARTITION BY page_id // 10, (page_id % 10) // 3 ORDER BY page_id) AS INTEGER) AS image_number,
  CASE WHEN page_id % 3 = 0 THEN 'jpeg' ELSE 'png' END AS format FROM pages"""
    # text
    o["n1_clean_app"] = f"SELECT doc_id, {clean_app('text')} AS clean FROM documents"
    o["n2_clean_basic"] = f"SELECT page_id, {clean_basic('html')} AS clean FROM pages"
    o["n3_clean_summary"] = f"SELECT doc_id, {clean_summary('text')} AS clean FROM documents"
    o["n4_word_count"] = f"SELECT doc_id, CAST({wc('text')} AS INTEGER) AS n_words FROM documents"
    o["n5_ellipsize"] = f"SELECT doc_id, {ellipsize('text', 50)} AS title, {ellipsize('text', 500)} AS preview FROM documents"
    lo = "greatest(floor(length(text) / 3)::INTEGER - 50, 0)"
    o["n6_span_context"] = f"""SELECT doc_id, substr(text, {lo} + 1,
  greatest(least(length(text), floor(length(text) / 3)::INTEGER + 10 + 50) - {lo}, 0)) AS context FROM documents"""
    o["n7_display_formats"] = """SELECT doc_id, format('{:,}', n_chars) AS chars,
  printf('%.1f KB', n_chars / 1024.0::DOUBLE) AS kb, upper(lang[1]) || lower(lang[2:]) AS lang,
  printf('%.1f%%', n_chars::DOUBLE / (n_chars + 1000) * 100.0::DOUBLE) AS share FROM documents"""
    # segmentation
    o["g1_sentences"] = f"SELECT doc_id, pos, sentence, CAST({wc('sentence')} AS INTEGER) AS n_words FROM ({sentences_sql(D)}) s"
    o["g2_paragraph_sections_contracts"] = paragraphs_sql(C)
    o["g2_line_sections_documents"] = paragraphs_sql(D, "chr(10)")
    o["g3_sentence_sections"] = groups_sql(D)
    o["g4_ensure_section"] = f"""WITH p AS ({paragraphs_sql(D)})
SELECT {sec_cols} FROM p UNION ALL
SELECT {sec_cols} FROM ({whole_sql(D)}) w WHERE doc_id NOT IN (SELECT doc_id FROM p)"""
    o["g5_header_sections"] = g5_sql(C)
    o["g6_heading_sections"] = g6_sql()
    hdr = " OR ".join(f"regexp_matches({strip('line')}, {q(re2(p))})" for p in V.SUMMARY_HEADER_PATTERNS)
    o["g7_section_header_lines"] = f"""SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line FROM (
  SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {C} c) x) y WHERE {hdr}"""
    toks = r"regexp_extract_all(lower(text), '([\p{L}\p{N}]+)', 1)"
    o["g8_word_tokens"] = f"""SELECT doc_id, CAST(len({toks}) AS INTEGER) AS n_tokens,
  md5(array_to_string({toks}, ' ')) AS tokens_md5 FROM documents"""
    o["g9_key_points"] = f"""SELECT doc_id, CAST(unnest(range(len(kp))) AS INTEGER) AS kp_no, unnest(kp) AS key_point
FROM (SELECT doc_id, list_filter({sents('text')}, lambda z: {wc('z')} > 5)[1:3] AS kp FROM {C} c) x"""
    # classification
    o["c1_section_types"] = f"SELECT type, confidence, count(*) AS n FROM ({paragraphs_sql(C)}) p GROUP BY type, confidence"
    o["c2_classify_lines"] = c2_sql()
    o["c3_document_type_contracts"] = f"SELECT doc_id, {doc_type('text')} AS document_type FROM {C} c"
    o["c3_document_type_documents"] = f"SELECT doc_id, {doc_type('text')} AS document_type FROM documents"
    o["c7_class_weights"] = """WITH l AS (SELECT CAST(l.quality AS VARCHAR) AS label FROM documents d
  JOIN labels l ON d.doc_id = l.doc_id),
c AS (SELECT label, count(*) AS n_c FROM l GROUP BY label)
SELECT label, n_c, round((SELECT sum(n_c) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * n_c), 6) AS weight FROM c"""
    o["c8_missing_labels"] = f"""SELECT label FROM {_values([(c,) for c, _ in V.CLAUSE_TYPES])} t(label)
WHERE label NOT IN (SELECT DISTINCT {ctype_sql('doc_id')} FROM {C} c WHERE doc_id % 10 <> 9)"""
    rules = _values([(t, p) for t, _, _, p in RISK_RULES])
    o["c9_risks"] = f"""WITH s AS ({g5_sql(C)}),
h AS (SELECT s.doc_id, r.type, min(s.sec_no) AS first_sec FROM s, {rules} r(type, pattern)
      WHERE regexp_matches(s.text, r.pattern) GROUP BY s.doc_id, r.type),
a AS (SELECT doc_id, count(*) AS n, string_agg(type, '|' ORDER BY first_sec, type) AS types FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(a.n, 0) AS INTEGER) AS n_risks, coalesce(a.types, '') AS types
FROM {C} d LEFT JOIN a ON d.doc_id = a.doc_id"""
    # entities
    o["e1_pattern_entities"] = e1_sql(C)
    o["e2_e3_gazetteer_entities"] = gazetteer_sql(C)
    o["e4_legal_terms"] = f"""SELECT doc_id, source, ord, text, label, start, "end", round(confidence, 6) AS confidence
FROM ({legal_sql(C)}) l"""
    o["e5_cue_entities"] = cue_sql(f"(SELECT doc_id * 1000 + sec_no AS doc_id, text FROM ({g5_sql(C)}) g)")
    o["e6_e7_entities_documents"] = f"""SELECT doc_id, source, ord, text, label, round(confidence, 6) AS confidence
FROM ({all_entities_sql(D)}) e"""
    o["e7_entities_contracts"] = f"""SELECT doc_id, source, ord, text, label, round(confidence, 6) AS confidence
FROM ({all_entities_sql(C)}) e"""
    o["e8_entities_by_label"] = f"""WITH e AS ({all_entities_sql(C)}),
g AS (SELECT doc_id, label, min(src_rank * 1000000 + ord) AS first, count(*) AS n,
        string_agg(text, '|' ORDER BY src_rank, ord) AS texts FROM e GROUP BY doc_id, label)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS INTEGER) AS label_no, label,
  CAST(n AS INTEGER) AS n, texts FROM g"""
    types = _values(list(V.ENTITY_TYPES))
    o["e9_describe_entities"] = f"""SELECT l.doc_id, l.source, l.ord, l.label, coalesce(t.description, '') AS description
FROM ({legal_sql(C)}) l LEFT JOIN {types} t(label, description) ON l.label = t.label"""
    o["e10_clause_key_terms"] = f"""SELECT doc_id, sec_no, array_to_string(regexp_extract_all(text, {q(ENTITY_ALT)}), ', ')
  AS key_terms FROM ({g5_sql(C)}) s"""
    o["e11_valid_spans"] = e11_sql()
    # summaries
    o["m1_summary_contracts"] = m1_out(C)
    o["m1_summary_documents"] = m1_out(D)
    o["m2_legal_summary"] = m2_sql(C)
    o["m3_tfidf_summary"] = m3_sql(D)
    o["m4_summary_stats"] = f"""SELECT doc_id, CAST({wc('text')} AS INTEGER) AS original_length,
  CAST({wc(LINE2)} AS INTEGER) AS summary_length,
  round(CASE WHEN {wc('text')} > 0 THEN {wc(LINE2)}::DOUBLE / {wc('text')} ELSE 0.0 END, 6) AS compression_ratio
FROM {C} c"""
    o["m5_key_phrases"] = m5_sql(D)
    o["m9_summaries"] = f"SELECT doc_id, {short_summary('summary')} AS short_summary FROM ({m1_sql(C)}) m"
    # metrics
    o["a1_warnings"] = f"SELECT doc_id, warnings FROM ({analysis_sql()}) a"
    o["a2_span_prf"] = f"""SELECT label, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1 FROM ({a2_sql()}) a"""
    o["a3_span_diff"] = f"""WITH p AS (SELECT DISTINCT doc_id, start, "end", label FROM ({pred_sql()}) x),
g AS (SELECT DISTINCT doc_id, start, "end", label FROM ({gold_sql()}) y)
SELECT *, 'tp' AS kind FROM (SELECT * FROM p INTERSECT SELECT * FROM g) a
UNION ALL SELECT *, 'fp' FROM (SELECT * FROM p EXCEPT SELECT * FROM g) b
UNION ALL SELECT *, 'fn' FROM (SELECT * FROM g EXCEPT SELECT * FROM p) c"""
    o["a4_classification_report"] = a4_sql()
    o["a5_word_overlap"] = f"""WITH m AS ({m1_sql(C)}), c AS (SELECT doc_id, {LINE2} AS gold FROM {C} x),
w AS (SELECT m.doc_id, {word_set('m.summary')} AS ps, {word_set('c.gold')} AS gs FROM m JOIN c ON m.doc_id = c.doc_id)
SELECT doc_id, round(CASE WHEN len(gs) > 0 THEN len(list_intersect(ps, gs))::DOUBLE / len(gs) END, 6) AS overlap
FROM w"""
    ents = f"({all_entities_sql(C)})"
    o["a6_entity_stats"] = f"""SELECT label, count(*) AS n, round(avg(confidence), 6) AS avg_confidence FROM {ents} e
WHERE confidence >= 0.7 GROUP BY label"""
    o["a7_label_distribution"] = f"""SELECT label, n, round(n::DOUBLE / sum(n) OVER (), 6) AS share
FROM (SELECT label, count(*) AS n FROM {ents} e GROUP BY label) x"""
    o["a8_clause_stats"] = f"""SELECT type, count(*) AS n, round(avg(confidence), 6) AS avg_confidence
FROM ({paragraphs_sql(C)}) p WHERE confidence >= 0.7 GROUP BY type"""
    o["a9_clause_metrics"] = f"""SELECT doc_id, sec_no, round(confidence, 6) AS confidence,
  CAST({wc('text')} AS INTEGER) AS n_words, CAST(len({sents('text')}) AS INTEGER) AS n_sentences
FROM ({paragraphs_sql(C)}) p"""
    o["a10_document_kpis"] = """SELECT doc_id, n_ent_thr AS n_entities, n_clauses, round(avg_conf, 6) AS avg_confidence
FROM (""" + analysis_sql() + ") a"
    o["a11_label_options"] = f"SELECT DISTINCT label FROM {ents} e"
    # filters
    dates = f"regexp_extract_all(text, {q(V.DATE_PATTERN)})"
    o["f1_date_mentions"] = f"""SELECT doc_id, CAST(len({dates}) AS INTEGER) AS n_dates,
  array_to_string({dates}, ', ') AS dates FROM {C} c"""
    o["f2_filter_entities"] = f"""SELECT doc_id, source, ord, text, label FROM {ents} e
WHERE confidence >= 0.8 AND label IN ('SECTION_TYPE', 'DATE', 'PARTY') AND contains(lower(text), 'part')"""
    o["f3_filter_clauses"] = f"""SELECT doc_id, sec_no, type FROM ({paragraphs_sql(C)}) p
WHERE confidence >= 0.85 AND contains(lower(text), 'notice')"""
    o["f4_filter_metadata"] = f"""SELECT doc_id, 'created_date,modified_date' AS keys FROM {C} c
WHERE contains({iso('modified_at')}, '1998')"""
    o["f5_search_contracts"] = f"""SELECT filename, {q(ANALYZED_AT)} AS analyzed_at FROM ({analysis_sql()}) a
WHERE filename ILIKE '%customer#00000001%' OR summary ILIKE '%customer#00000001%'
   OR len(list_filter({metadata_values_sql('a')}, lambda v: v ILIKE '%customer#00000001%')) > 0"""
    o["f6_top_k_entities"] = f"""SELECT doc_id, CAST(rank AS INTEGER) AS rank, source, ord, text FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, src_rank, ord) AS rank FROM {ents} e) x
WHERE rank <= 2"""
    # prep
    o["d1_prepare_ner"] = f"""SELECT doc_id, CAST(count(*) AS INTEGER) AS n,
  string_agg(CAST(start AS VARCHAR) || ':' || CAST("end" AS VARCHAR) || ':' || label, ',' ORDER BY o) AS spans
FROM ({gold_sql()}) g GROUP BY doc_id"""
    o["d2_prepare_classifier"] = f"SELECT doc_id, {ctype_sql('doc_id')} AS label FROM {C} c WHERE doc_id % 10 <> 9"
    o["d3_prepare_summarization"] = f"SELECT doc_id, {LINE2} AS summary FROM {C} c"
    o["d4_split_rows"] = """SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)),
  doc_id) <= ceil(0.2::DOUBLE * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM documents"""
    o["d5_split_stratified"] = """WITH l AS (SELECT doc_id, CAST(quality AS VARCHAR) AS label FROM labels)
SELECT doc_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)),
  doc_id) <= floor(0.2::DOUBLE * count(*) OVER (PARTITION BY label) + 0.5) THEN 'test' ELSE 'train' END AS split
FROM l"""
    # the annotated label follows from a line of the contract, so every held-out row has to be predicted right
    held = f"""(SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id)
    <= floor(0.2::DOUBLE * count(*) OVER (PARTITION BY label) + 0.5) AS test FROM ({o['d2_prepare_classifier']}) l)"""
    o["c6_predict_clauses"] = f"""SELECT doc_id, h.label AS predicted, description, true AS sure FROM {held} h
JOIN {_values(V.CLAUSE_TYPES)} t(label, description) ON t.label = h.label WHERE test"""
    o["s11_model_roundtrip"] = f"SELECT label AS predicted, count(*) AS n FROM {held} h WHERE test GROUP BY label"
    # composite
    o["x1_analyze_contracts"] = x1_sql()
    o["x1_analyze_documents"] = x1_sql(DOCS_AS_CONTRACTS.replace("['pdf', 'docx', 'txt'][doc_id % 3 + 1]", "['pdf', 'docx'][doc_id % 2 + 1]"))
    submitted = iso("modified_at - to_days(CAST(40 * (doc_id % 3) AS INTEGER))")
    o["x4_stream_contracts"] = f"""SELECT filename, file_type, n_entities, n_sections, section_types, document_type, summary, compression_ratio,
  CAST(file_size AS VARCHAR) AS file_size, {submitted} AS analyzed_at FROM ({analysis_sql()}) a"""
    from clauselake.plans import learned

    return o | learned.oracle_sql()


def html_text(x: str) -> str:
    t = f"regexp_replace({x}, '(?is)<script\\b.*?</script[^>]*>', ' ', 'g')"
    t = f"regexp_replace({t}, '(?is)<style\\b.*?</style[^>]*>', ' ', 'g')"
    t = f"regexp_replace({t}, '(?s)<!--.*?-->', ' ', 'g')"
    t = f"regexp_replace({t}, '<[^>]*>', ' ', 'g')"
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = f"replace({t}, {q(a)}, {q(b)})"
    return t


def c2_sql() -> str:
    lines = f"""SELECT doc_id, CAST(unnest(range(len(ls))) AS INTEGER) AS line_no, unnest(ls) AS line
FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {CONTRACTS} c) x"""
    cats = []
    for cat, pats in V.CLAUSE_RULES:
        pts = " + ".join(
            f"(CASE len(regexp_extract_all(line, {q('(?i)' + re2(p))})) WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 5 ELSE 7 END)"
            for p in pats)
        cats.append((cat, f"({pts})"))
    cols = ", ".join(f"{e} AS p{i}" for i, (_, e) in enumerate(cats))
    total = " + ".join(f"p{i}" for i in range(len(cats)))
    best = "greatest(" + ", ".join(f"p{i}" for i in range(len(cats))) + ")"
    arms = " ".join(f"WHEN p{i} = {best} THEN {q(c)}" for i, (c, _) in enumerate(cats))
    return f"""WITH l AS ({lines}), s AS (SELECT doc_id, line_no, {cols} FROM l)
SELECT doc_id, line_no, CASE WHEN {total} = 0 THEN 'DEFINITION' ELSE (CASE {arms} END) END AS category,
  round(CASE WHEN {total} > 0 THEN {best}::DOUBLE / ({total}) ELSE 0.0 END, 6) AS confidence FROM s"""


def a2_sql() -> str:
    labels = _values([(lab,) for lab, _ in V.ENTITY_TYPES])
    return f"""WITH p AS (SELECT DISTINCT doc_id, start, "end", label FROM ({pred_sql()}) x),
g AS (SELECT DISTINCT doc_id, start, "end", label FROM ({gold_sql()}) y),
j AS (SELECT coalesce(p.label, g.label) AS label, p.doc_id IS NOT NULL AS hp, g.doc_id IS NOT NULL AS hg
      FROM p FULL OUTER JOIN g ON p.doc_id = g.doc_id AND p.start = g.start AND p."end" = g."end"
        AND p.label = g.label),
c AS (SELECT label, count(*) FILTER (WHERE hp AND hg) AS tp, count(*) FILTER (WHERE hp AND NOT hg) AS fp,
        count(*) FILTER (WHERE hg AND NOT hp) AS fn FROM j GROUP BY label),
t AS (SELECT d.label, CAST(coalesce(tp, 0) AS BIGINT) AS tp, CAST(coalesce(fp, 0) AS BIGINT) AS fp,
        CAST(coalesce(fn, 0) AS BIGINT) AS fn FROM {labels} d(label) LEFT JOIN c ON d.label = c.label),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0 END AS precision,
        CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0 END AS recall FROM t),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END
        AS f1 FROM m)
SELECT label, tp, fp, fn, precision, recall, f1 FROM f
UNION ALL SELECT 'overall', CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(fn) AS BIGINT),
  avg(precision), avg(recall), avg(f1) FROM f"""


def a4_sql() -> str:
    gold = f"{qlist(CLOSING_TYPES)}[doc_id % {len(CLOSING_TYPES)} + 1]"
    return f"""WITH d AS (SELECT {gold} AS y, {doc_type('text')} AS p FROM {CONTRACTS} c),
cls AS (SELECT y AS label FROM d UNION SELECT p FROM d),
t AS (SELECT label, (SELECT count(*) FROM d WHERE y = label) AS support,
        (SELECT count(*) FROM d WHERE p = label) AS npred,
        (SELECT count(*) FROM d WHERE y = label AND p = label) AS tp FROM cls),
m AS (SELECT *, CASE WHEN npred > 0 THEN tp::DOUBLE / npred ELSE 0.0 END AS precision,
        CASE WHEN support > 0 THEN tp::DOUBLE / support ELSE 0.0 END AS recall FROM t),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END
        AS f1 FROM m),
tot AS (SELECT sum(support) AS n, sum(tp) AS tp, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
          sum(precision * support) AS wp, sum(recall * support) AS wr, sum(f1 * support) AS wf FROM f)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
  CAST(support AS BIGINT) AS support FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, round(tp::DOUBLE / n, 6), CAST(n AS BIGINT) FROM tot
UNION ALL SELECT 'macro avg', round(mp, 6), round(mr, 6), round(mf, 6), CAST(n AS BIGINT) FROM tot
UNION ALL SELECT 'weighted avg', round(wp / n, 6), round(wr / n, 6), round(wf / n, 6), CAST(n AS BIGINT) FROM tot"""


def word_set(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({x}), {q(WS + '+')}), lambda z: z <> ''))"


def e11_sql() -> str:
    word = WORDCH
    def ch(p):
        return f"substr(text, {p}, 1)"

    def isw(p):
        return f"regexp_matches({ch(p)}, {q('^' + word + '$')})"

    def boundary(p):
        return f"({p} = 0 OR {p} = length(text) OR NOT ({isw(p)} AND {isw(p + ' + 1')}))"

    spans = f"""SELECT g.doc_id, c.text, g.start, g."end" FROM ({gold_sql()}) g JOIN {CONTRACTS} c ON g.doc_id = c.doc_id
UNION ALL
SELECT g.doc_id, c.text, g.start + 1, g."end" FROM ({gold_sql()}) g JOIN {CONTRACTS} c ON g.doc_id = c.doc_id
WHERE g.label = 'PARTY' AND g.doc_id % 4 = 0"""
    ws = q('^' + WS + '$')
    return f"""WITH s AS ({spans})
SELECT doc_id, CAST(count(*) AS INTEGER) AS n_valid FROM s
WHERE start >= 0 AND "end" <= length(text) AND start < "end"
  AND NOT regexp_matches(substr(text, start + 1, 1), {ws}) AND NOT regexp_matches(substr(text, "end", 1), {ws})
  AND {boundary('start')} AND {boundary('"end"')}
GROUP BY doc_id"""
