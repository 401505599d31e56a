"""Session settings and the few places where data is cut or bounded."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_SIDE_ROWS = 200_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_session(app: str = "benchweave", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution; ``master`` and partitions only matter for local runs."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a local one only in local mode without a setting (tests)."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not configured:
        configured = os.path.join(tempfile.gettempdir(), "benchweave-checkpoints")
    context.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` on reliable storage so that iterative plans stay short and survive lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep_table(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder as Parquet: compressed, and each reader takes only its columns.

    For wide tables that several outputs read; a checkpoint would hold all their rows uncompressed. The shuffle files of
    the write are removed as soon as it has finished.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/kept/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, max_rows: int = SMALL_SIDE_ROWS) -> DataFrame:
    """Hint a broadcast only after counting that the side stays under ``max_rows``.

    The probe reads at most ``max_rows + 1`` rows. A larger side is returned without a hint: Spark then
    shuffles both sides and adaptive execution splits skewed keys.
    """
    found = df.limit(max_rows + 1).count()
    return F.broadcast(df) if found <= max_rows else df


def spread(df: DataFrame, limit: int = 1024) -> int:
    """How many pieces a hot group is cut into: follows the session's shuffle width."""
    configured = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(8, min(limit, configured))
