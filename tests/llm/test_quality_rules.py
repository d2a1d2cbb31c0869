import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from clauselake.llm import quality_rules as qr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for x in w for c in x), dup, len(again), len(w) < 10 or 100 * len(again) > 20 * len(w)


def kneser_ney(texts):
    """p(c | a b) by the formulas, with dictionaries."""
    c3 = Counter(t[i : i + 3] for t in texts for i in range(len(t) - 2))
    c2, c1 = Counter(g[1:] for g in c3), Counter()
    for g in c2:
        c1[g[1:]] += 1

    def discounts(c):
        n = Counter(c.values())
        if not (n[1] and n[2]):
            return [0, 0.5, 0.5, 0.5]
        y = n[1] / (n[1] + 2 * n[2])
        return [0] + [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0), k) if n[k] else 0.5 * k for k in (1, 2, 3)]

    d1, d2, d3 = discounts(c1), discounts(c2), discounts(c3)
    after2, after3 = defaultdict(list), defaultdict(list)
    for g, n in c2.items():
        after2[g[:1]].append(n)
    for g, n in c3.items():
        after3[g[:2]].append(n)

    def p(g):
        all1 = sum(c1.values())
        q = (c1[g[2:]] - d1[min(c1[g[2:]], 3)]) / all1 + sum(d1[min(n, 3)] for n in c1.values()) / all1 / 256
        for counts, after, d, key in ((c2, after2, d2, g[1:]), (c3, after3, d3, g)):
            of = after[key[:-1]]
            if of:
                q = (counts[key] - d[min(counts[key], 3)]) / sum(of) + sum(d[min(n, 3)] for n in of) / sum(of) * q
        return q

    return c3, p


def texts_of(seed, n=80):
    r = random.Random(seed)
    vocab = ["the", "of", "é", "ab|c", "x#", "日本", "<p>", "long" * 5]
    return ["".join(r.choice(vocab) + r.choice([" ", "\n", "\t", "  ", " \x0c"]) for _ in range(r.choice([0, 3, 12, 60, 300]))) for _ in range(n)]


def test_model_equals_the_formulas(spark):
    texts = texts_of(1)
    model = qr.train(spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string").repartition(3))
    c3, p = kneser_ney([t.encode() for t in texts])
    assert len(model.codes) == len(c3)
    for code, bits in zip(model.codes.tolist(), model.bits.tolist()):
        assert abs(bits + math.log2(p(code.to_bytes(3, "big")))) < 1e-4
    total = sum(p(b"th" + bytes([c])) for c in range(256))
    assert abs(total - 1) < 1e-9
    got, n = model.entropies(pa.array([texts[5] + "the of the", "", None, "ab"]))
    raw = (texts[5] + "the of the").encode()
    want = [-math.log2(p(raw[i : i + 3])) if raw[i : i + 3] in c3 else 24.0 for i in range(len(raw) - 2)]
    assert abs(got[0] - np.mean(want)) < 1e-3 and np.isnan(got[1:]).all() and n.tolist() == [len(raw) - 2, 0, 0, 0]


def test_base_counts_match_brute_force(spark):
    texts = texts_of(2) + [None, "", "a\n\na\n \n \na", "w " * 50, " ".join(map(str, range(100)))]
    df = spark.createDataFrame([(i, t, "en", "k") for i, t in enumerate(texts)], "doc_id long, text string, lang string, kept string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in qr.apply_rules(df).collect()}
    assert got == {i: base(t) for i, t in enumerate(texts)}


def test_bands_reject_what_is_far_off(spark):
    r = random.Random(3)
    words = {"en": [f"{a}{b}" for a in ("sto", "ther", "win", "la") for b in ("ing", "ed", "ly", "tion")], None: ["ürgöß", "schlö", "ßeit", "äuml", "zübe"]}
    rows = [(i, " ".join(r.choices(words[lang], k=r.randint(60, 300))) + f" {i}", lang) for i in range(400) for lang in [r.choice(["en", None])]]
    # as varied as possible, so no 5-word window comes twice
    rows = [(i, t, lang) for i, t, lang in rows if not base(t)[5]]
    junk = [(1000 + i, " ".join("".join(chr(r.randint(0x4E00, 0x9000)) for _ in range(6)) for _ in range(40)), "en") for i in range(3)]
    df = spark.createDataFrame([(*x, 1) for x in rows + junk], "doc_id long, text string, lang string, bits int")
    out = {x.doc_id: x for x in qr.apply_rules(df).collect()}
    assert all(out[i].kept for i, _, _ in rows) and len(rows) > 100
    assert not any(out[i].kept or out[i].base_failed for i, _, _ in junk)
    assert all(out[i].lower < out[i].perplexity < out[i].upper for i, _, lang in rows if lang == "en")
    assert all(out[i].perplexity > out[i].upper for i, _, _ in junk)
    left = qr.keep_good(df)
    assert left.columns == df.columns and {x.doc_id for x in left.collect()} == {i for i, _, _ in rows}


def test_empty_table_and_empty_texts(spark):
    schema = "doc_id long, text string, lang string"
    assert qr.apply_rules(spark.createDataFrame([], schema)).count() == 0
    got = qr.apply_rules(spark.createDataFrame([(1, None, None), (2, "", "x"), (None, "a b", "x")], schema)).collect()
    assert len(got) == 3 and not any(r.kept for r in got) and all(r.base_failed for r in got)
