"""DuckDB SQL fragments for the oracle queries.

The oracle re-states each operator relationally (unnest + window +
group by) in DuckDB SQL; only fixed values (patterns, word lists) are
shared with the Spark side.  DuckDB string literals keep backslashes, so
regex text is passed through verbatim; RE2 needs the 'g' flag for a global
replace.
"""

from __future__ import annotations

from clauselake import vocab as V
from clauselake.functions.text import jre

WS = V.WS
NWS = f"[^{V.WS_CHARS}]"
WORDCH = r"[\p{L}\p{N}_]"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def qlist(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + WS + '+|' + WS + '+$')}, '', 'g')"


def squash(x: str) -> str:
    return f"trim(regexp_replace({x}, {q(WS + '+')}, ' ', 'g'))"


def wc(x: str) -> str:
    return f"len(regexp_extract_all({x}, {q(NWS + '+')}))"


def sents(x: str) -> str:
    """Sentence list of a text (same rule as G1)."""
    marked = f"regexp_replace({x}, {q('([.!?])' + WS + '+')}, '\\1' || chr(1), 'g')"
    return (f"list_filter(list_transform(string_split({marked}, chr(1)), lambda z: {strip('z')}), "
            f"lambda z: z <> '')")


def contains_count(low: str, terms) -> str:
    return f"len(list_filter({qlist(terms)}, lambda t: contains({low}, t)))"


def doc_type(text: str) -> str:
    """C3 as a CASE over per-type keyword counts; first type wins a tie."""
    low = f"lower({text})"
    scores = [(name, " + ".join(f"(CASE WHEN contains({low}, {q(w)}) THEN 1 ELSE 0 END)" for w in words))
              for name, words in V.DOC_TYPE_KEYWORDS]
    best = "greatest(" + ", ".join(f"({s})" for _, s in scores) + ")"
    arms = " ".join(f"WHEN ({s}) = {best} THEN {q(n)}" for n, s in scores)
    return f"(CASE WHEN {best} = 0 THEN 'document' {arms} END)"


def fix_punct(x: str) -> str:
    for a, b in ((" .", "."), (" ,", ","), ("..", "."), (".,", ",")):
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


def ordered_distinct(lst: str) -> str:
    return f"list_filter({lst}, lambda v, i: list_position({lst}, v) = i)"


def ellipsize(x: str, n: int) -> str:
    return f"(CASE WHEN length({x}) > {n} THEN substr({x}, 1, {n}) || '...' ELSE {x} END)"


def section_type(x: str) -> tuple[str, str]:
    """C1 -> (type expr, confidence expr)."""
    low = f"lower({x})"
    t, c = [], []
    for label, conf, words in V.SECTION_TYPE_RULES:
        cond = " OR ".join(f"contains({low}, {q(w)})" for w in words)
        t.append(f"WHEN {cond} THEN {q(label)}")
        c.append(f"WHEN {cond} THEN {conf}::DOUBLE")
    dt, dc = V.DEFAULT_SECTION_TYPE
    return (f"(CASE {' '.join(t)} ELSE {q(dt)} END)", f"(CASE {' '.join(c)} ELSE {dc}::DOUBLE END)")


def clean_app(x: str) -> str:
    t = squash(f"replace({x}, chr(0), '')")
    for a, b in ((" .", "."), (" ,", ","), ("..", "."), (".,", ","), ("  ", " ")):
        t = f"replace({t}, {q(a)}, {q(b)})"
    return strip(t)


def clean_basic(x: str) -> str:
    t = squash(f"replace({x}, chr(0), '')")
    t = strip(f"replace(replace({t}, ' .', '.'), ' ,', ',')")
    return f"nullif({t}, '')"


def clean_summary(x: str) -> str:
    t = f"regexp_replace({x}, {q(WS + '+')}, ' ', 'g')"
    t = f"regexp_replace({t}, {q('[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_' + V.WS_CHARS + '.,;:!?()]')}, ' ', 'g')"
    t = f"regexp_replace({t}, {q(WS + '+([.,;:!?])')}, '\\1', 'g')"
    t = f"regexp_replace({t}, {q(chr(92) + '.+')}, '.', 'g')"
    t = f"regexp_replace({t}, {q('([.!?])' + WS + '*([A-Z])')}, '\\1 \\2', 'g')"
    return strip(t)


def iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S')"


def re2(p: str) -> str:
    """A Python regex restated for RE2 (same rule as the Spark side)."""
    return jre(p)


PARTY_ALT = "|".join(f"(?:{p})" for lab, p in V.PATTERN_ENTITY_RULES if lab == "PARTY")
ENTITY_ALT = "|".join(f"(?:{p})" for _, p in V.PATTERN_ENTITY_RULES)
