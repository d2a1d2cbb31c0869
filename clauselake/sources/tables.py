"""Driver tables (S1) and the document-shaped views derived from them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_contracts(spark: SparkSession, path: str,
                   columns: tuple[str, ...] = ("doc_id", "filename", "text")) -> DataFrame:
    """Contract table scan with an explicit projection (column pruning
    reaches the Parquet reader's ReadSchema)."""
    return spark.read.parquet(path).select(*columns)


def documents_as_contracts(spark: SparkSession, sf_dir: str,
                           suffixes: tuple[str, ...] = ("pdf", "docx")) -> DataFrame:
    """``documents`` in the ``contracts_in`` shape.

    The table carries no file names, so a deterministic one is derived from
    ``doc_id`` (the suffixes in turn); ``file_size`` is the UTF-8 byte length
    of the text.
    """
    d = table(spark, sf_dir, "documents")
    suffix = F.element_at(F.array(*map(F.lit, suffixes)), (F.col("doc_id") % len(suffixes) + 1).cast("int"))
    return d.select(
        "doc_id",
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("."), suffix).alias("filename"),
        F.upper(suffix).alias("file_type"),
        "text",
        F.octet_length("text").cast("long").alias("file_size"),
    )


def contracts_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract view in the ``contracts_in`` shape (doc_id, filename,
    file_type, text, file_size, modified_at)."""
    from clauselake.sources.fixtures import contract_view

    cv = contract_view(spark, sf_dir)
    return cv.select(
        "doc_id", "filename",
        F.upper(F.regexp_extract("filename", r"\.([^.]*)$", 1)).alias("file_type"),
        "text",
        F.octet_length("text").cast("long").alias("file_size"),
        "modified_at",
    )


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Spread the rows of a *scan* over all cores before CPU-heavy per-row
    text work.

    A scan of few large row groups yields fewer partitions than the
    cluster has cores; then the rows are round-robin repartitioned.  At
    scale the scan already has >= parallelism partitions and nothing is
    added (no shuffle).  Apply it to scans only: for a plan with shuffles
    the partition count is only known once adaptive execution has run its
    stages."""
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df
