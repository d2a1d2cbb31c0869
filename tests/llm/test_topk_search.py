import math
import random

import pytest

from clauselake.llm import topk_search as ts

SCHEMA = "vec_id long, embedding array<double>, score string"


def brute(rows, k=5):
    rows = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in rows:
        if i % 50 == 0:
            asked[i] = min(asked.get(i, v), v)
    out = set()
    for q, u in asked.items():
        rest = list(rows)
        rest.remove((q, u))
        scored = sorted((-sum(a * b for a, b in zip(u, v)), i) for i, v in rest)
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)}
    return out


def rows_of(seed, n=400, dims=12):
    r = random.Random(seed)
    rows = [(i, [r.choice([0.0, r.uniform(-1, 1)]) for _ in range(dims)]) for i in range(n)]
    rows += [(n, None), (n + 1, []), (n + 2, [1.0, None]), (n + 3, [float("nan")] * dims), (n + 4, [float("inf")] + [0.0] * 11), (None, [1.0] * dims)]
    rows += [(450, [0.0] * dims), (500, [0.5] * dims), (500, [0.5] * dims), (550, [0.25, 0.5]), (7, rows[7][1]), (1000, [1.0] * 30)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("least", [1024, 40])
def test_matches_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(ts, "LEAST", least)
    rows = rows_of(least)
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    assert {tuple(r) for r in ts.search(df).collect()} == brute(rows)


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(ts, "BLOCK", 4)
    monkeypatch.setattr(ts, "LEAST", 60)
    rows = rows_of(3, 120)
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    assert {tuple(r) for r in ts.search(df).collect()} == brute(rows)


def test_huge_components_and_few_rows(spark):
    rows = [(0, [1e20, 1.0]), (1, [1e20, 2.0]), (2, [-1e20, 0.0]), (3, [1e10, 0.0])]
    got = [tuple(r) for r in ts.search(spark.createDataFrame([(*x, "") for x in rows], SCHEMA)).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 2**63 - 1), (0, 2, 3, 2**63 - 1), (0, 3, 2, -(2**63))]
    assert ts.search(spark.createDataFrame([(0, [1.0], "")], SCHEMA)).count() == 0
    assert ts.search(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ties_go_to_smaller_ids(spark):
    rows = [(i, [1.0, 0.0]) for i in range(60)]
    got = {tuple(r) for r in ts.search(spark.createDataFrame([(*x, "") for x in rows], SCHEMA)).collect()}
    assert got == brute(rows)
