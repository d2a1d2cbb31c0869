"""The corpus pipeline: ``documents`` through the stages in ``STAGES``.

Each stage takes what the one before kept and returns the columns of
``documents`` (the last one the encoded documents):

1. toxicity: documents that it rejects go;
2. MinHash near-dedup: of each group (links: 80 % of the 5-word shingles) the
   smallest id stays;
3. substring dedup: words of passages that a smaller document has go; a text
   that loses some becomes its kept words joined by one space;
4. mixing sources: each document is emitted as often as its source's rate and
   its hash say, so a document may come twice or not at all;
5. BPE encoding: the ids, and digests of ids and decoded text, of each copy.

``n_chars`` follows the text.  Tables without rows pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselake.llm import bpe_stream, mix_sources, near_dup, substring_dedup, toxicity
from clauselake.session import ship_package, work_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not predicted toxic (learned from labelled rows of the
    stage's own input)."""
    ship_package(spark)
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that stand for their near-duplicate group, by links of 80 % of the
    5-word shingles."""
    ship_package(spark)
    return near_dup.keep_one(docs, percent=80, shingle=5)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words of 13-word windows that a smaller document has."""
    ship_package(spark)
    return substring_dedup.remove_repeats(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents so that sources come near their targets."""
    return mix_sources.emit(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each copy, and its ids."""
    import public_tokenizers

    ship_package(spark)
    return bpe_stream.code_digests(docs, public_tokenizers.path("word_bpe_49k.json"), ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", keep_one_of_each_group),
    ("substring_dedup", drop_repeated_passages),
    ("source_mixing", mix),
    ("bpe_coding", encode),
]

#: The first stage's model is beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``STAGES`` over the whole ``documents`` table, each written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = work_dir(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
