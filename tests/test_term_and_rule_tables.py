"""E2/E3 with term lists and C9 with rule tables of any size: equal to trying
every pair, without a nested-loop join."""

import random
import re

import pytest
from pyspark.sql import functions as F

from clauselake.operators import entities as E
from clauselake.operators import gram_index as GI
from clauselake.operators import rule_table as RT

WORDS = ["pier", "Mooring", "lease", "ß", "ÉTÉ", "a", "no", "rent", "x.y", "crates", "OF", "the", "😀z", "dusk"]


def texts_and_terms(n_terms, seed=1):
    r = random.Random(seed)
    texts = [(i, " ".join(r.choices(WORDS, k=r.randrange(60)))) for i in range(40)] + [(100, None), (101, ""), (102, "pi"), (103, "A")]
    terms = {"a", "pi", "R L", "lease no", "", "absent term", "😀", "é", "the the", "OF THE PIER"}
    while len(terms) < n_terms:
        terms.add(" ".join(r.choices(WORDS, k=r.randrange(1, 4))) + r.choice(["", "", f" {r.randrange(n_terms)}"]))
    return texts, sorted(terms)


def brute(texts, terms):
    return {(i, t) for i, x in texts if x is not None for t in terms if t and t.lower() in x.lower()}


@pytest.mark.parametrize("n, broadcast", [(300, None), (300, 0), (100_000, None)])
def test_term_lists_equal_every_pair(spark, n, broadcast):
    texts, terms = texts_and_terms(n)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    listed = spark.createDataFrame([(i, t, "L") for i, t in enumerate(terms)], "ord int, term string, label string")
    got = E.term_entities(df, listed, "ctx", "user", broadcast_bytes=broadcast)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    rows = got.collect()
    assert len(rows) == len({(r.doc_id, r.text) for r in rows})
    assert {(r.doc_id, r.text) for r in rows} == brute(texts, terms)
    assert {(r.ord, r.source, r.label, r.context) for r in rows} == {(terms.index(t), "user", "L", "ctx") for _, t in brute(texts, terms)}


def test_no_terms_or_no_texts(spark):
    df = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    for terms in ([], [(0, "", "L")], [(0, "other", "L")]):
        assert E.term_entities(df, spark.createDataFrame(terms, "ord int, term string, label string"), "c", "s").count() == 0
    assert E.term_entities(df.limit(0), spark.createDataFrame([(0, "text", "L")], "ord int, term string, label string"), "c", "s").count() == 0


def test_the_rarest_gram_is_the_key(spark):
    texts = spark.createDataFrame([(i, "common words here" + (" rarity" if i == 3 else "")) for i in range(9)], "doc_id long, text string")
    lits = spark.createDataFrame([("common words",), ("words here rarity",)], "literal string")
    keys = {r.literal: r._gram for r in GI.index(lits, texts).collect()}
    held = texts.filter("doc_id = 0").select(F.explode(GI.text_grams(F.col("text"), [5])).alias("g"))
    assert {r.g for r in held.collect()} & set(keys.values()) == {keys["common words"]}


@pytest.mark.parametrize("pattern, want", [
    ("(?i)written notice", ["written notice"]),
    ("liability .* capped", ["liability ", " capped"]),
    (r"may\s+not (?:ever )?assign", ["may", "not ", "assign"]),
    ("colou?r scheme", ["colo", "r scheme"]), ("ab+cd", []), ("abc+def", ["abc", "def"]), ("abc{0,2}xyz", ["xyz"]), ("abcd{2}xyz", ["abcd", "xyz"]),
    ("one|other", []), ("(one|other) thing", [" thing"]), ("[abc]def", ["def"]), ("[^]x]abc", []), (r"cost \$5\.00", ["cost $5.00"]),
    (r"\bfinal\b", ["final"]), (r"\p{Lu}nder way", ["nder way"]), (r"\Qa.b\E", []), (r"(?iu)sink", []), ("(?x)a b c d", []), ("été total", [" total"]),
    ("*abc", []), ("(((abc)", []), ("(?!not )really", ["really"]), ("(?=foo)bar[)]baz", ["bar", "baz"]), ("abc\\", []), ("x{,3}abc", []), ("FINAL Part", ["final part"]), ("", []),
])
def test_literals_of_patterns(pattern, want):
    assert RT.required_literals(pattern) == want


PATTERNS = ["(?i)mooring lease", "rent .* crates", r"\bno\b", "pier|dusk", "[a-z]{6} of", "OF( the)? pier", "x\\.y crates?", "lease{1,2}", "zzz never", "(?i)THE PIER$", "(?iu)dusk", "", "a"]


@pytest.mark.parametrize("broadcast", [GI.BROADCAST_BYTES, 0])
def test_rule_tables_equal_every_pair(spark, broadcast):
    r = random.Random(3)
    secs = [(d, s, " ".join(r.choices(WORDS, k=r.randrange(25)))) for d in range(25) for s in range(4)] + [(30, 0, None), (31, 0, "")]
    rules = [(f"T{i % 4}", f"d{i}", "high", p) for i, p in enumerate(PATTERNS)] + [("T0", "d0", "high", PATTERNS[0]), ("none", "x", "low", None)]
    many = [("T9", f"n{i}", "low", f"number {i} of") for i in range(3000)]
    sections = spark.createDataFrame(secs, "doc_id long, sec_no int, text string")
    table = spark.createDataFrame(rules + many, "type string, description string, severity string, pattern string")
    got = RT.rule_hits(sections, table, broadcast_bytes=broadcast)
    want = {(d, s, *rule) for d, s, t in secs if t is not None for rule in rules if rule[3] is not None and re.search(rule[3], t)}
    assert sorted(map(tuple, got.collect())) == sorted(want)
    docs = sections.select("doc_id").distinct()
    lists = {x.doc_id: [(h.type, h.description) for h in x.risks] for x in RT.table_risks(docs, sections, table, broadcast_bytes=broadcast).collect()}
    firsts = {}
    for d, s, t, desc, sev, _ in want:
        firsts[d, t, desc, sev] = min(s, firsts.get((d, t, desc, sev), s))
    assert lists == {d: [(t, desc) for s, t, desc in sorted((s, t, desc) for (e, t, desc, _), s in firsts.items() if e == d)] for d in {x[0] for x in secs}}


def test_no_rules(spark):
    sections = spark.createDataFrame([(1, 0, "text")], "doc_id long, sec_no int, text string")
    empty = spark.createDataFrame([], "type string, description string, severity string, pattern string")
    assert [tuple(r) for r in RT.table_risks(sections.select("doc_id"), sections, empty).collect()] == [(1, [])]


def test_grams_of_bytes_equal_slices():
    import numpy as np
    import pyarrow as pa

    r = random.Random(4)
    texts = ["", None, "a", "abc", "ß😀z", *["".join(r.choices("abß😀 ", k=r.randrange(40))) for _ in range(50)]]
    hashes = {n: dict() for n in GI.SIZES}
    for n in GI.SIZES:
        rows, places, found = GI._batch_grams(pa.array(texts), [n], None, None)
        want = [(i, k, t.encode()[k : k + n]) for i, t in enumerate(texts) if t for k in range(len(t.encode()) - n + 1)]
        assert list(zip(rows.tolist(), places.tolist())) == [w[:2] for w in want]
        for g, w in zip(found.tolist(), want):
            assert hashes[n].setdefault(w[2], g) == g
        assert len(set(hashes[n].values())) == len(hashes[n])
    some = np.sort(np.array(list(hashes[3].values())[:5] + list(hashes[8].values())[:5], np.int64))
    got = GI._batch_grams(pa.array(texts).slice(3), [3, 8], some, GI._bitmap(some))
    every = GI._batch_grams(pa.array(texts).slice(3), [3, 8], None, None)
    assert sorted(zip(*map(np.ndarray.tolist, got))) == sorted(x for x in zip(*map(np.ndarray.tolist, every)) if x[2] in set(some.tolist()))


def test_long_literals_meet_few_texts_without_them(spark, tmp_path):
    """Pairs of words that share five characters around the space, but no more."""
    from clauselake.session import ship_package

    ship_package(spark)
    pairs = [f"{a}{i}ing {j}{b}" for i, a in enumerate(("mo", "sa", "pa", "ro", "li", "wa")) for j, b in enumerate(("one", "two", "six", "ten"))]
    terms = [f"x{p}" for p in pairs] + [f"lease of {w} rent" for w in ("a1", "b2", "c3", "d4")]
    texts = spark.createDataFrame([(i, f"{t} and more") for i, t in enumerate(terms)], "doc_id long, text string")
    lits = spark.createDataFrame([(t,) for t in terms], "literal string")
    found, sizes = GI._byte_index(lits, texts, str(tmp_path), "literal", "text", None, GI.BROADCAST_BYTES)
    held = GI._byte_grams(texts, "text", sizes, None, ["doc_id"]).select("doc_id", F.explode("_grams").alias("_gram"))
    assert max(sizes) == 12 and held.join(found, "_gram").count() <= 2 * len(terms)
    assert {(r.doc_id, r.literal) for r in GI.occurrences(texts, lits).collect()} == {(i, x) for i, t in enumerate(terms) for x in terms if x in t}


def test_candidates_hold_all_literals_of_a_pattern():
    assert RT._runs(r"(?i)house: customer#0*7\s+corp") == ["house: customer#", "7", "corp"]
    assert RT.required_literals(r"(?i)house: customer#0*7\s+corp") == ["house: customer#", "corp"] and RT._runs("a|b") == []


def test_memory_follows_the_chunk(monkeypatch):
    """A whole batch's grams of all sizes were held at once before."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(GI, "CHUNK", 64)
    r = random.Random(6)
    texts = [None, "", *["".join(r.choices("abcß ", k=r.choice((3, 20, 63, 64, 65, 400)))) for _ in range(80)]]
    sizes = [1, 3, 12]
    held = [sum(len(p[0]) for p in parts) for _, _, parts in GI._groups(pa.array(texts[2:40] * 1), sizes, None)]
    assert len(held) > 20
    pairs = [(i, g) for rows, found in GI._distinct_groups(pa.array(texts), sizes, None) for i, g in zip(rows.tolist(), found.tolist())]
    assert len(pairs) == len(set(pairs)) == sum(len({t.encode()[k : k + n] for k in range(len(t.encode()) - n + 1)}) for t in texts if t for n in sizes)
    some = np.sort(np.array([g for _, g in pairs[:50]], np.int64))
    got = {x for rows, found in GI._distinct_groups(pa.array(texts), sizes, GI._Known(some, GI._bitmap(some))) for x in zip(rows.tolist(), found.tolist())}
    assert got == {x for x in pairs if x[1] in set(some.tolist())}


def test_the_bitmap_lets_the_set_pass_and_little_else(spark):
    import numpy as np

    grams = [0, -1, 1 << 62, -(1 << 63), 12345, *(random.Random(7).getrandbits(64) - (1 << 63) for _ in range(2000))]
    known = GI._known(GI._filter(spark.createDataFrame([(g,) for g in grams], "_gram long")))
    assert len(known.places(np.array(grams, np.int64))) == len(grams)
    others = np.random.default_rng(8).integers(-(1 << 63), 1 << 63, 100_000, np.int64)
    assert len(known.places(others)) < 50


def test_hashed_pieces_are_freed_at_once():
    """Each piece's arrays stayed in a reference cycle before."""
    import gc
    import tracemalloc

    import numpy as np

    data = np.zeros(1 << 16, np.uint8)
    gc.collect()
    gc.disable()
    tracemalloc.start()
    try:
        for _ in range(20):
            for _n, _h in GI._hashes(data, list(GI.SIZES)):
                pass
            del _h
        assert tracemalloc.get_traced_memory()[0] < 1 << 20
    finally:
        tracemalloc.stop()
        gc.enable()
