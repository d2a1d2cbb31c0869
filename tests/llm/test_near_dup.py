import random
import re

import numpy as np
import pyarrow as pa
import pytest

from clauselake.llm import near_dup as nd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or frozenset([tuple(w)])


def brute(rows, k=3, percent=85):
    s = {i: shingles(t, k) for i, t in rows}
    ids, parent = sorted(s), {i: i for i in s}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for p, a in enumerate(ids):
        for b in ids[p + 1 :]:
            n = len(s[a] & s[b])
            if n and 100 * n >= percent * len(s[a] | s[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {(i, len(s[i]), root(i), root(i) == i) for i in ids}


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"W{i}x" for i in range(500)]
    rows, n = [], 0
    for _ in range(25):
        base = r.choices(vocab, k=r.randint(3, 200))
        for _ in range(r.choice([1, 1, 2, 8, 30])):
            words = list(base)
            for _ in range(r.choice([0, 0, 1, 2, len(base) // 20, len(base) // 12])):
                words[r.randrange(len(words))] = r.choice(vocab)
            if r.random() < 0.3:  # drift: chains of links
                base = words
            rows.append((n, (" " if r.random() < 0.5 else "\n ").join(w.lower() if r.random() < 0.5 else w for w in words)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "\t"), (n + 3, "One"), (n + 4, "one "), (n + 5, "one two"), (n + 6, "one two one two"), (n + 7, "É x"), (n + 8, "é x")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n string, sig int").repartition(5)
    assert {tuple(x) for x in nd.groups(df).collect()} == brute(rows)


def test_mixed_buckets_lose_no_link(spark, monkeypatch):
    """Buckets so coarse that pivots link little: the block comparison has to find the rest."""
    monkeypatch.setattr(nd, "BANDS", 1)
    monkeypatch.setattr(nd, "ROWS", 125)
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(nd, "BLOCK", 7)
    # one bucket for all: the first slot of each signature is cut off, the key is constant
    true = nd.F.substring
    monkeypatch.setattr(nd.F, "substring", lambda *_: nd.F.lit(b""))
    try:
        got = {tuple(x) for x in nd.groups(df).collect()}
    finally:
        monkeypatch.setattr(nd.F, "substring", true)
    assert got == brute(rows)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        n, j = int(rng.integers(5, 900)), rng.uniform(0.2, 0.95)
        same = int(n * 2 * j / (1 + j))
        pool = rng.integers(0, 2**63, 2 * n - same, dtype=np.int64).astype(np.uint64)
        a, b = pool[:n], np.concatenate((pool[:same], pool[n:]))
        true = same / len(pool)
        sig = nd.signatures(np.concatenate((a, b)), np.array([0, n, 2 * n]))
        errors.append((sig[0] == sig[1]).mean() - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.045


def test_superminhash_by_the_book():
    """Element by element, with each element's own permutation."""
    rng = np.random.default_rng(2)
    items = rng.integers(0, 2**63, 40, dtype=np.int64).astype(np.uint64)
    m = 16
    best = [2**64 - 1] * m
    for e in items:
        p = list(range(m))
        for j in range(m):
            x = int(nd.scan.mix(np.array([(int(e) + 0x9E3779B97F4A7C15 * (j + 1)) % 2**64], np.uint64))[0])
            k = j + ((x & 0xFFFFFFFF) * (m - j) >> 32)
            p[j], p[k] = p[k], p[j]
            best[p[j]] = min(best[p[j]], (j << 32) | (x >> 32))
    want = (nd.scan.mix(np.array(best, np.uint64)) >> np.uint64(32)).astype(np.uint32)
    assert (nd.signatures(items, np.array([0, len(items)]), m)[0] == want).all()


def test_components_of_long_chains(spark):
    r = random.Random(1)
    ids = list(range(300))
    r.shuffle(ids)
    links = [(min(a, b), max(a, b)) for a, b in zip(ids[:199], ids[1:200])] + [(min(a, b), max(a, b)) for a, b in zip(ids[200:249], ids[201:250])]
    got = dict(map(tuple, nd.components(spark.createDataFrame(links, "a long, b long").repartition(9)).collect()))
    lo, hi = min(ids[:200]), min(ids[200:250])
    assert got == {**{i: lo for i in ids[:200] if i != lo}, **{i: hi for i in ids[200:250] if i != hi}}


def test_odd_tables(spark):
    schema = "doc_id long, text string, kept string"
    assert nd.groups(spark.createDataFrame([], schema)).count() == 0
    same = " ".join(f"t{i}" for i in range(20))
    df = spark.createDataFrame([(5, same, "a"), (5, same, "a"), (9, same.upper(), "b"), (None, same, "c"), (7, None, "d"), (8, "z" * 200000 + " y x", "e")], schema)
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in nd.groups(df).collect())
    assert got == [(-1, 18, None, True), (5, 18, 5, True), (5, 18, 5, True), (7, 0, 7, True), (8, 1, 8, True), (9, 18, 5, False)]
    left = nd.keep_one(df)
    assert left.columns == df.columns
    assert sorted(r.kept for r in left.collect()) == ["a", "a", "c", "d", "e"]


def test_sets_of_short_texts():
    items, at = nd.sets(pa.array(["a b c d", "a", "", None, "a b", "A B"]))
    assert np.diff(at).tolist() == [2, 1, 0, 0, 1, 1] and items[at[4]] == items[at[5]] != items[at[1]]


def test_links_at_80_percent_of_5_words(spark):
    """Copies with a contiguous block cut or put in, at 0.80 to 0.85; scattered edits below 0.80 are none."""
    r = random.Random(5)
    new = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    rows, near = [], set()
    for _ in range(40):
        base = new(r.randint(150, 400))
        n = len(base) - 4
        cut = int(n * r.uniform(0.16, 0.17)) - 6
        at = r.randrange(5, len(base) - cut - 5)
        rows += [(len(rows), base), (len(rows) + 1, base[:at] + base[at + cut :]), (len(rows) + 2, base[:at] + new(n // 5 - 10) + base[at:])]
        near |= {len(rows) - 2, len(rows) - 1}
    for _ in range(20):
        base = new(200)
        other = list(base)
        for k in range(6, 200, 40):
            other[k] = new(1)[0]
        rows += [(len(rows), base), (len(rows) + 1, other)]
    grams = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    like = lambda a, b, k: len(grams(a, k) & grams(b, k)) / len(grams(a, k) | grams(b, k))
    for i in near:
        first = i // 3 * 3
        assert 0.8 <= like(rows[first][1], rows[i][1], 5) < 0.85
    for i in range(120, len(rows), 2):
        assert like(rows[i][1], rows[i + 1][1], 5) < 0.8 and like(rows[i][1], rows[i + 1][1], 3) >= 0.85
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    left = {x.doc_id for x in nd.keep_one(df, percent=80, shingle=5).collect()}
    assert left == {i for i, _ in rows} - near


def test_banding_follows_the_percentage():
    assert nd.banding(85) == (25, 5, 0.72)
    for percent in (30, 50, 70, 80, 90, 95, 100):
        bands, rows, agree = nd.banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= nd.MISS and bands * rows <= nd.MOST_SLOTS
        assert agree <= percent / 100 - 4 * (percent / 100 * (1 - percent / 100) / (bands * rows)) ** 0.5 + 1e-9
