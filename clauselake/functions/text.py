"""Column-level text functions (JVM-side, no Python UDFs).

Each function maps Column -> Column and runs inside whole-stage codegen
(regexp/replace/trim) or as a built-in higher-order function.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clauselake import vocab as V

SEP = "\u0001"  # sentence break marker; never present in clean text


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def jre(pattern: str) -> str:
    """Restate a Python regex for Java regex / RE2.

    ``\\s`` becomes the explicit whitespace class (inside a character class,
    its members) and ``\\d`` becomes ``\\p{Nd}`` (Python's digits are
    Unicode).  Everything else is already common syntax.
    """
    out, i, in_class = [], 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            if nxt == "s":
                out.append(V.WS_CHARS if in_class else V.WS)
            elif nxt == "d":
                out.append(r"\p{Nd}")
            else:
                out.append(ch + nxt)
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        out.append(ch)
        i += 1
    return "".join(out)


def lit_str_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


# --- whitespace --------------------------------------------------------------
def strip(c) -> Column:
    """Python ``str.strip()`` over the common whitespace class."""
    return F.btrim(col_(c), F.lit(" \t\n\r\f\x0b"))


def squash(c) -> Column:
    """``' '.join(s.split())``: collapse whitespace runs, strip the ends."""
    return F.trim(F.regexp_replace(col_(c), f"{V.WS}+", " "))


# --- N1 / N2 / N3 ------------------------------------------------------------
def clean_app(c) -> Column:
    """NUL out, whitespace squashed, punctuation fixes in fixed order.
    ``replace`` is a single left-to-right non-overlapping pass, like Python."""
    t = squash(F.replace(col_(c), F.lit("\x00"), F.lit("")))
    for a, b in ((" .", "."), (" ,", ","), ("..", "."), (".,", ","), ("  ", " ")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return strip(t)


def clean_basic(c) -> Column:
    """NUL out, whitespace squashed, space before . and , removed;
    empty result -> NULL."""
    t = squash(F.replace(col_(c), F.lit("\x00"), F.lit("")))
    t = F.replace(F.replace(t, F.lit(" ."), F.lit(".")), F.lit(" ,"), F.lit(","))
    t = strip(t)
    return F.when(t != "", t)


def clean_summary(c) -> Column:
    """The TF-IDF summariser's pre-processing."""
    t = F.regexp_replace(col_(c), f"{V.WS}+", " ")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}_" + V.WS_CHARS + r".,;:!?()]", " ")
    t = F.regexp_replace(t, f"{V.WS}+([.,;:!?])", "$1")
    t = F.regexp_replace(t, r"\.+", ".")
    t = F.regexp_replace(t, f"([.!?]){V.WS}*([A-Z])", "$1 $2")
    return strip(t)


# --- N4 .. N7 ----------------------------------------------------------------
def word_count(c) -> Column:
    """Number of non-empty whitespace-separated tokens."""
    return F.regexp_count(col_(c), F.lit(f"[^{V.WS_CHARS}]+")).cast("int")


def more_words_than(c, n: int) -> Column:
    """``word_count(c) > n``, without taking the words out."""
    return col_(c).rlike(rf"^{V.WS}*+(?:[^{V.WS_CHARS}]++{V.WS}++){{{n}}}[^{V.WS_CHARS}]")


def ellipsize(c, n: int) -> Column:
    """First n characters + '...' when longer than n."""
    c = col_(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def span_context(text, start, end, width: int = 50) -> Column:
    """text[max(0, start-w) : min(len, end+w)] (0-based, end exclusive)."""
    text, start, end = col_(text), col_(start), col_(end)
    lo = F.greatest(start - width, F.lit(0))
    hi = F.least(F.length(text), end + width)
    return text.substr(lo + 1, F.greatest(hi - lo, F.lit(0)))


#: Characters of a piece of a text that many spans are cut from.
PIECE_BITS = 10


def pieces_of(text) -> Column:
    """A text as struct(length, pieces of ``2**PIECE_BITS`` characters): cutting a
    span from it does not walk the text from its start."""
    parts = F.regexp_extract_all(col_(text), F.lit(f"(?s).{{1,{1 << PIECE_BITS}}}"), 0)
    return F.get(F.transform(F.array(parts), lambda p: F.struct(
        F.when(F.size(p) > 0, F.shiftleft(F.size(p) - 1, PIECE_BITS) + F.length(F.get(p, F.size(p) - 1))).otherwise(F.lit(0)).alias("n"), p.alias("p"))), 0)


def cut(pieces: Column, lo: Column, hi: Column) -> Column:
    """Characters lo..hi-1 (0-based, inside the text) from its pieces."""
    first = F.shiftright(lo, PIECE_BITS)
    last = F.shiftright(F.greatest(hi - 1, lo), PIECE_BITS)
    return F.array_join(F.slice(pieces["p"], first + 1, last - first + 1), "").substr(lo - F.shiftleft(first, PIECE_BITS) + 1, F.greatest(hi - lo, F.lit(0)))


def cut_context(pieces: Column, start: Column, end: Column, width: int = 50) -> Column:
    """N6 from a text's pieces."""
    return cut(pieces, F.greatest(start - width, F.lit(0)), F.least(pieces["n"], end + width))


def fmt_percent(x, dp: int = 1) -> Column:
    """Python ``f"{x:.{dp}%}"`` (ties go to the even digit)."""
    return F.format_string(f"%.{dp}f%%", F.bround(col_(x) * 100.0, dp))


def fmt_thousands(x) -> Column:
    """Python ``f"{n:,}"`` for integers."""
    return F.format_number(col_(x), 0)


def fmt_kb(x) -> Column:
    """Python ``f"{n / 1024:.1f} KB"``."""
    return F.format_string("%.1f KB", F.bround(col_(x) / 1024.0, 1))


def fmt_title(x) -> Column:
    """Python ``str.title()``: the first letter of each run of letters in
    upper case, the others in lower case (so also after ``-`` and ``'``)."""
    runs = F.regexp_extract_all(col_(x), F.lit(r"\p{L}+|\P{L}+"), 0)
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(r.substr(F.lit(2), F.length(r))))), "")


# --- G7 / G8 / F1 ------------------------------------------------------------
def is_section_header(c) -> Column:
    """Stripped text matches one of three whole-line header shapes."""
    s = strip(c)
    cond = None
    for p in V.SUMMARY_HEADER_PATTERNS:
        m = s.rlike(jre(p.replace("$", r"\z")))
        if p.endswith(":$"):  # most texts are told by their last character
            m = s.endswith(":") & m
        cond = m if cond is None else (cond | m)
    return cond


def word_tokens(c) -> Column:
    """Lower-cased alphanumeric tokens (word_tokenize + isalnum re-aimed)."""
    return F.regexp_extract_all(F.lower(col_(c)), F.lit(r"([\p{L}\p{N}]+)"), 1)


def date_mentions(c) -> Column:
    """numeric or month-name dates, in order of appearance."""
    return F.regexp_extract_all(col_(c), F.lit(f"(?=[0123456789JFMASOND])(?:{V.DATE_PATTERN})"), 0)


def sentence_array(text) -> Column:
    """G1: sentences of a text (break after [.!?] + whitespace; a trailing
    unterminated piece is a sentence), each stripped, empties dropped."""
    marked = F.regexp_replace(col_(text), f"([.!?]){V.WS}+", "$1" + SEP)
    return F.filter(F.transform(F.split(marked, SEP), lambda s: strip(s)), lambda s: s != "")


def contains_any_count(lower_text: Column, terms) -> Column:
    """Number of literal terms contained in an already lower-cased text."""
    return F.size(F.filter(lit_str_array(terms), lambda t: F.contains(lower_text, t)))
