"""Session helpers: local session for tests/bench, shared work folder."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "clauselake") -> SparkSession:
    """Session for tests and the local bench (a cluster passes its own)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared ``spark.checkpoint.dir``, ready for
    ``DataFrame.checkpoint()``.

    The setting is read from the session.  Where it is unset, a single-JVM
    local session (tests, bench) gets a folder of its own; a cluster gets an
    error, since a machine-local folder would be lost with its machine.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="clauselake-ckpt-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(base)
    return base


def work_dir(spark: SparkSession, name: str | None = None) -> str:
    """A fresh folder under the shared checkpoint folder; whatever a job writes
    to cut lineage or to stage an upsert goes there."""
    return "/".join((ensure_checkpoint_dir(spark).rstrip("/"), name or "work", uuid.uuid4().hex))


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below the shared checkpoint folder and read back: what
    takes it several times does not compute it again."""
    path = work_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, once for each application (a session
    started with ``--py-files`` or from the package's folder has it already)."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="clauselake-code-"), "clauselake"), "zip",
                                  os.path.dirname(here), os.path.basename(here))
    context.addPyFile(archive)  # Spark's own file server hands it out
    _shipped.add(context.applicationId)


_shipped: set[str] = set()
