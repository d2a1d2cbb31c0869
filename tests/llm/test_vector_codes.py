import hashlib
import math
import random

import numpy as np
import pytest

from clauselake.llm import vector_codes as vc

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label string, code string"


def brute(rows):
    """The contract word for word, in plain Python."""
    known = [(i, v, lab) for i, v, lab in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    least = {}
    for i, v, _ in known:
        least[i] = min(least.get(i, v), v)
    kept = [(i, [math.floor(4096 * x) if abs(x) < 2**53 else int(x) * 4096 for x in v], lab) for i, v, lab in known + [(i, v, ...) for i, v in sorted(least.items())[:16]]]
    if not kept:
        return []
    width = -(-max(len(v) for _, v, _ in kept) // 8) * 8
    kept = [(i, [min(max(x, -(2**62)), 2**62) for x in v] + [0] * (width - len(v)), lab) for i, v, lab in kept]
    step = width // 8
    start, kept = [v for _, v, lab in kept if lab is ...], [r for r in kept if r[2] is not ...]
    near = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, e)), n) for n, e in enumerate(book))
    books = [[v[p * step : (p + 1) * step] for v in start] for p in range(8)]
    for p in range(8):
        for _ in range(6):
            own = [[] for _ in books[p]]
            for _, v, _ in kept:
                part = v[p * step : (p + 1) * step]
                own[near(part, books[p])[1]].append(part)
            books[p] = [[sum(c) // len(o) for c in zip(*o)] if o else e for e, o in zip(books[p], own)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    coded = []
    for i, v, lab in kept:
        best = [near(v[p * step : (p + 1) * step], books[p]) for p in range(8)]
        coded.append((i, lab, "".join("%02x" % n for _, n in best), min(sum(d for d, _ in best), 2**63 - 1)))
    total = {}
    for _, lab, _, e in coded:
        total[lab] = total.get(lab, 0) + e
    return sorted((i, c, e, min(total[lab], 2**63 - 1), digest) for i, lab, c, e in coded)


def got(df, **how):
    return sorted(map(tuple, vc.encode(df, **how).collect()))


@pytest.mark.parametrize("seed,trie", [(1, 32768), (2, 7), (3, 64)])
def test_matches_brute_force(spark, seed, trie):
    r = random.Random(seed)
    rows = [(r.randrange(300), [r.choice([0.0, 0.5, r.uniform(-1, 1), r.uniform(-0.001, 0.001)]) for _ in range(16)], r.choice("abc") if r.random() < 0.8 else None) for _ in range(260)]
    rows += [(5, None, "a"), (6, [], "a"), (7, [0.1, None], "a"), (8, [float("nan")] * 16, "b"), (9, [float("-inf")] + [0.0] * 15, None), (None, [1.0] * 16, "a")]
    rows += [(400, rows[0][1], "hot")] * 100 + [(401, [0.25] * 11, None), (402, [-0.25] * 19, "z")]
    r.shuffle(rows)
    assert got(spark.createDataFrame([(*x, "x") for x in rows], SCHEMA), trie_rows=trie) == brute(rows)


def test_huge_components(spark):
    rows = [(i, [x, -x] + [0.5] * 6, "a") for i, x in enumerate([1e300, 1e20, 1e14, 1e9, 1.5, -1e300, 2.0**52, 1e9])]
    assert got(spark.createDataFrame([(*x, "x") for x in rows], SCHEMA)) == brute(rows)


def test_few_or_no_rows(spark):
    one = [(3, [1.0, 2.0], None)]
    assert got(spark.createDataFrame([(*x, "x") for x in one], SCHEMA)) == brute(one)
    assert vc.encode(spark.createDataFrame([], SCHEMA)).collect() == []
    assert vc.encode(spark.createDataFrame([(1, None, "a", "x")], SCHEMA)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_without_a_label_column_all_errors_are_summed(spark):
    df = spark.createDataFrame([(i, [i / 7.0] * 8) for i in range(40)], "vec_id long, embedding array<double>")
    rows = vc.encode(df).collect()
    assert {r.label_error for r in rows} == {sum(r.error for r in rows)}


def test_query_against_brute_force(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, [float(x) for x in r.embedding] if r.embedding is not None else None, r.label) for r in df.select("vec_id", "embedding", "label").collect()]
    assert got(df) == brute(rows)


@pytest.mark.parametrize("block", [16384, 7, 1])
def test_trie_gives_plain_distances(monkeypatch, block):
    monkeypatch.setattr(vc, "BLOCK", block)
    rng = np.random.default_rng(0)
    parts, weight, place = vc.distinct(rng.integers(-3, 3, (500, 4)))
    book = rng.integers(-3, 3, (5, 4))
    plain = ((parts[:, None] - book) ** 2).sum(2)
    best, error = vc.Trie(parts, weight).nearest(book)
    assert (best == plain.argmin(1)).all() and (error == plain.min(1)).all() and weight.sum() == 500 and place.max() == len(parts) - 1
    nodes = [len(v) for v in vc.Trie(parts, weight).values]
    assert nodes[0] == 6 and nodes == sorted(nodes) and nodes[-1] == len(parts)


def test_decode_returns_codebook_entries():
    books = [np.array([[4096, 0], [2048, -4096]])] * 8
    assert vc.decode("00" * 7 + "01", books) == [1.0, 0.0] * 7 + [0.5, -1.0]
