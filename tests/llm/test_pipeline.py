"""The pipeline against a brute-force version of its stages."""

import hashlib
import os
import struct
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stage_names_and_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "minhash_near_dedup", "substring_dedup", "source_mixing", "bpe_coding"]
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns and df.dtypes == stages[0].dtypes


def test_toxicity_drops_whole_rows_and_keeps_clean_ones(spark, stages):
    before, after = ({tuple(r) for r in df.collect()} for df in stages[:2])
    clean = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 0").collect()}
    assert after <= before
    assert len({r[0] for r in before - after} & clean) <= 0.05 * len(clean)


def test_near_dedup_keeps_one_of_each_group(stages):
    from tests.llm.test_near_dup import brute

    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    assert {r.doc_id for r in stages[2].collect()} == {i for i, _, _, kept in brute(rows, 5, 80) if kept}


def test_substring_dedup_takes_effect(stages):
    from tests.llm.test_substring_dedup import brute

    want = {(i, digest) for i, _, gone, digest in brute([(r.doc_id, r.text) for r in stages[2].collect()])}
    rows = stages[3].collect()
    assert {(r.doc_id, hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest()) for r in rows} == want
    assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)


def test_mixing_emits_copies(stages):
    from clauselake.llm import mix_sources

    taken = {r.doc_id: (r["size"], r.taken) for r in mix_sources.taken(stages[3]).collect()}
    copies = Counter(r.doc_id for r in stages[4].collect())
    assert all(copies[i] * size == n for i, (size, n) in taken.items() if size)
    assert set(copies) <= set(taken)


def test_coding_equals_the_library(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in stages[4].collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in stages[5].collect()) == want


def test_run_gives_the_stages_rows(spark, stages):
    key = lambda df: sorted((r.doc_id, r.ids_sha256) for r in df.select("doc_id", "ids_sha256").collect())
    assert key(cp.run(spark, SF)) == key(stages[5])


def test_empty_and_odd_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "x " * 50000, "de", None, 100000)], docs.schema)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for k, (df, least) in enumerate(((docs, 0), (odd, 1))):
        for j, (_, stage) in enumerate(cp.STAGES):
            stage(spark, df, str(tmp_path)).write.parquet(str(tmp_path / f"{k}-{j}"))
            df = spark.read.parquet(str(tmp_path / f"{k}-{j}"))
        assert df.count() >= least
    assert os.path.isdir(tmp_path / "1-4") and df.filter(F.col("doc_id") == 3).count() >= 1
