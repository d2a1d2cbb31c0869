import random

from pyspark.sql import functions as F

from clauselake.llm import mix_sources as mix


def fill(sizes, budget=1.5, most=2.0):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, full, out = budget * sum(sizes.values()), set(), {}
    while True:
        open_ = [s for s in names if s not in full]
        if not open_:
            return out
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > most * sizes[s]]
        if not over:
            return out | {s: level * weight[s] for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            full.add(s)


def test_targets_equal_resharing(spark):
    r = random.Random(1)
    for n in (1, 2, 5, 23):
        sizes = {f"s{i}": r.choice([0, 1, 10, 500, 9000]) for i in range(n)}
        sizes[None] = 40
        df = spark.createDataFrame(list(sizes.items()), "_mix_source string, source_size long")
        got = {row["_mix_source"]: row["target"] for row in mix.targets(df).collect()}
        want = fill(sizes)
        assert got.keys() == want.keys()
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_taken_is_near_target_and_reruns_agree(spark):
    r = random.Random(2)
    rows = [(i, "w " * r.randint(0, 30), r.choice(["a", "b", "b", "b", "b", "ü", None])) for i in range(6000)]
    rows += [(7000, None, "a"), (7001, "", "empty"), (None, "x y", "a")]
    df = spark.createDataFrame([(*x, "extra") for x in rows], "doc_id long, text string, source string, size string")
    got = mix.taken(df)
    assert got.count() == len(rows)
    assert sorted(map(str, got.collect())) == sorted(map(str, mix.taken(df.repartition(3)).collect()))
    assert got.filter("taken > 2 * size or taken < 0").count() == 0
    for row in got.groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect():
        assert abs(row.t - row.target) <= 0.1 * row.target + 1
    emitted = mix.emit(df)
    assert emitted.columns == df.columns
    copies = {x.doc_id: x.n for x in emitted.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    for row in got.filter("size > 0").collect():
        assert copies.get(row.doc_id, 0) * row["size"] == row.taken


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    plan = mix.taken(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table_and_odd_spaces(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix.taken(empty).count() == 0 and mix.emit(empty).count() == 0
    df = spark.createDataFrame([(1, "a\x0bb\x0cc d e\rf\x1cg", "s")], "doc_id long, text string, source string")
    assert mix.taken(df).first()["size"] == 4
