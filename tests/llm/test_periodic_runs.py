import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from clauselake.llm import periodic_runs as pr

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, start string"


def brute_runs(w):
    """Runs by trying every period from the smallest; a stretch of period q has a
    smaller one only if that divides q."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q) and not any(q % d == 0 and w[i : i + q] == w[i : i + d] * (q // d) for d in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def sha(b):
    return hashlib.sha256(b).hexdigest()


def brute(doc_id, text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    return (doc_id, len(runs), *best, None if not runs else 1000 * best[1] // best[2],
            sha("".join("%d,%d,%d\n" % r for r in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def found(words):
    codes = {}
    key = np.array([codes.setdefault(x, len(codes)) for x in words], np.uint64)
    return [tuple(r[1:]) for r in pr.find_runs(key, np.array([0, len(words)])).tolist()]


@pytest.mark.parametrize("seed", range(6))
def test_random_words_over_small_alphabets(seed):
    r = random.Random(seed)
    for _ in range(150):
        w = []
        while len(w) < r.choice([5, 30, 90, 200]):
            root = [r.choice("abc"[: r.randint(1, 3)]) for _ in range(r.choice([1, 1, 2, 3, 4, 5, 7, 8, 9, 16, 17]))]
            w += (root * 12)[: r.randint(1, 6 * len(root))]
        assert found(w) == brute_runs(w)


@pytest.mark.parametrize("q", [1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 32, 33, 40, 64, 65])
def test_lengths_around_the_limit_at_every_offset(q):
    for before in [*range(9), 31, 63, 64, 65]:
        for length in (4 * q - 1, 4 * q, 4 * q + 1, 5 * q, max(6, 4 * q)):
            w = [f"x{i}" for i in range(before)] + [f"r{i % q}" for i in range(length)] + ["end"] * 2
            assert found(w) == brute_runs(w)


def test_texts_of_a_slice_do_not_mix():
    rows = [["a"] * 5, ["a"] * 5, [], ["a", "b"] * 3, ["a", "b"] * 4, ["a"] * 6]
    first = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    key = np.array([hash((i, x)) & (2**63 - 1) for i, r in enumerate(rows) for x in r], np.uint64)
    assert pr.find_runs(key, first).tolist() == [[4, 0, 8, 2], [5, 0, 6, 1]]


def test_wavelet_successor():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 200, 300)
    tree = pr.WaveletTree(values, 8)
    lo = rng.integers(0, 300, 500)
    hi = np.minimum(300, lo + rng.integers(0, 40, 500))
    x = rng.integers(0, 256, 500)
    want = [min((v for v in values[a:b].tolist() if v >= y), default=-1) for a, b, y in zip(lo, hi, x)]
    assert tree.successor(lo, hi, x).tolist() == want


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 10
    assert sorted(map(tuple, pr.run_digest(docs).collect())) == sorted(brute(*r) for r in rows)


def test_odd_inputs(spark):
    r = random.Random(5)
    rows = [(1, None), (2, ""), (2, " \t\n"), (3, "a " * 30000), (4, "  " * 7 + "x y " * 9), (4, "  " * 7 + "x y " * 9), (None, "b b b b b b c"),
            (None, None), (-7, "no runs here at all"), (10**15, "a b a b a b a b\x0ba b")]
    rows += [(i, " ".join(r.choices("ab", k=r.randrange(80)))) for i in range(100, 160)]
    df = spark.createDataFrame([(*x, "s") for x in rows], SCHEMA)
    assert sorted(map(tuple, pr.run_digest(df).collect()), key=repr) == sorted((brute(*x) for x in rows), key=repr)
    assert pr.run_digest(df.limit(0)).count() == 0 and pr.collapse_runs(df.limit(0)).count() == 0


def test_collapse_keeps_columns_and_other_texts(spark):
    df = spark.createDataFrame([(1, "x  y", "k"), (2, "a a a a a a  b", None), (3, None, "k")], SCHEMA)
    got = pr.collapse_runs(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=repr) == [(1, "x  y", "k"), (2, "a b", None), (3, None, "k")]


def test_very_long_texts_stay_quick():
    r = random.Random(3)
    words = ([r.choice("abcd") for _ in range(1000)] * 300) + ["q"] * 100_000 + [str(r.random()) for _ in range(200_000)]
    began = time.time()
    runs = found(words)
    assert time.time() - began < 60
    assert (0, 300_000, 1000) in runs and (300_000, 100_000, 1) in runs
