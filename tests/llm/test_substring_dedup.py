import hashlib
import random
import re

from clauselake.llm import substring_dedup as sd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k=13):
    """doc_id -> digest row, by every window of every smaller document."""
    words = {i: WORD.findall(t or "") for i, t in rows}
    least = {}
    for i, w in words.items():
        for p in range(len(w) - k + 1):
            s = tuple(w[p : p + k])
            least[s] = min(least.get(s, i), i)
    out = set()
    for i, w in words.items():
        gone = set()
        for p in range(len(w) - k + 1):
            if least[tuple(w[p : p + k])] < i:
                gone.update(range(p, p + k))
        kept = [x for p, x in enumerate(w) if p not in gone]
        out.add((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def corpus(seed, n=120):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["é", "日本", "x" * 300, "a b"]
    passages = [[r.choice(vocab) for _ in range(r.randint(12, 40))] for _ in range(8)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(r.randint(0, 6)):
            words += r.choice(passages) if r.random() < 0.5 else [r.choice(vocab) for _ in range(r.randint(1, 30))]
        rows.append((i, "".join(w + r.choice([" ", "\n", "  ", "\t\x0b", "\r\n"]) for w in words)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "same " * 400), (n + 4, "same " * 250), (n + 5, rows[3][1])]
    r.shuffle(rows)
    return rows


def test_matches_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
        got = {tuple(r) for r in sd.dedup_digest(df).collect()}
        assert got == brute(rows)


def test_small_windows_and_short_minimisers(spark):
    rows = corpus(3, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in sd.dedup_digest(df, k=5, m=2).collect()}
    assert got == brute(rows, 5)


def test_equal_hashes_are_told_apart(monkeypatch):
    import numpy as np

    rows = [(i, " ".join(random.Random(i).choices("abcdef", k=40))) for i in range(20)]
    words = [t.encode() for _, t in rows]
    lens = np.array([len(w) for w in words], np.int32)
    data = np.frombuffer(b"".join(words), np.uint8)
    ids = np.arange(20)
    want = set(zip(*(x.tolist() for x in sd._repeats(ids, lens, data, 3))))
    true = sd.scan.windows
    monkeypatch.setattr(sd.scan, "windows", lambda h, k: true(h, k) % np.uint64(7))
    assert want and set(zip(*(x.tolist() for x in sd._repeats(ids, lens, data, 3)))) == want


def test_rewrite_keeps_columns_and_untouched_texts(spark):
    long = " ".join(f"t{i}" for i in range(30))
    rows = [(1, long, "a", 5), (2, "x\n y " + long, None, 6), (3, "un  touched\n", "c", None), (3, None, "d", 1), (None, long, "e", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bucket string, id int")
    got = {(r.doc_id, r.bucket): r.text for r in sd.remove_repeats(df).collect()}
    assert got == {(1, "a"): long, (2, None): "x y", (3, "c"): "un  touched\n", (3, "d"): None, (None, "e"): ""}


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sd.dedup_digest(empty).count() == 0
    long = " ".join(f"t{i}" for i in range(30))
    rows = [(1, long), (1, long), (2, long)]
    got = sorted((r.doc_id, r.n_removed) for r in sd.dedup_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 0), (1, 0), (2, 30)]


def test_hot_minimisers_are_split(spark, monkeypatch):
    """A phrase in ever new surroundings: its windows are dealt out, and the result stays exact."""
    import numpy as np
    import pyarrow as pa

    r = random.Random(9)
    phrases = [[f"p{i}x{j}" for j in range(5)] for i in range(4000)]
    hashes = [int(sd.scan.windows(sd.scan.scan(pa.array([" ".join(p)])).hash, 5)[0]) for p in phrases]
    hot = phrases[int(np.argmin(hashes))]  # a minimiser of every window that holds it
    rows = [(i, " ".join([f"a{r.randrange(10**6)}" for _ in range(20)] + hot + [f"b{r.randrange(10**6)}" for _ in range(20)])) for i in range(300)]
    rows += [(300 + i, "x " + rows[i * 7][1]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(sd, "HOT_BYTES", 8192)
    keyed = sd._keyed(df, "text", "doc_id").withColumn("_sd_text", sd.F.col("text"))
    found = sd.hot_minimisers(keyed, sum(len(t) for _, t in rows))
    assert found.tolist() == [min(hashes)]
    batch = pa.RecordBatch.from_pydict({"_sd_id": [i for i, _ in rows], "_sd_key": pa.array([0] * len(rows), pa.int32()), "_sd_text": [t for _, t in rows]})
    most = lambda hot: max(len(sd._unpack(b.as_py())[-1]) for x in sd._cut([batch], 64, 13, 5, hot) for b in x.column("blob") if b.is_valid)
    assert 3 * most(found) < most(np.zeros(0, np.uint64))
    assert {tuple(x) for x in sd.dedup_digest(df).collect()} == brute(rows)
    for seed in (4, 5):
        monkeypatch.setattr(sd, "HOT_BYTES", 500)
        rows = corpus(seed)
        got = {tuple(x) for x in sd.dedup_digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
        assert got == brute(rows)
