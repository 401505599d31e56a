"""Intermediate tables in the shared folder, row keys, and the size-derived counts that the operators use."""

from __future__ import annotations

import math
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from benchweave.session import ensure_checkpoint_dir

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scope = threading.local()


@contextmanager
def collecting(tables: list[DataFrame]) -> Iterator[None]:
    """Note in ``tables`` what this thread stages meanwhile, so that its caller can ``discard`` just that."""
    before = getattr(_scope, "tables", None)
    _scope.tables = tables
    try:
        yield
    finally:
        _scope.tables = before


def stage(df: DataFrame, label: str, held: bool = False, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it back.

    The written table survives lost executors and ends the lineage; the shuffle files of the write are removed as
    soon as it has finished. ``discard`` removes the table; one that is not ``held`` is noted by ``collecting``.
    With ``by`` the files are kept in a folder for each of its values, so that readers of one value skip the others.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/staged/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    noted = getattr(_scope, "tables", None)
    if noted is not None and not held:
        noted.append(out)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Remove staged tables that no later step reads, that is, whose readers have all been staged or written themselves."""
    for table in tables:
        _delete(table.sparkSession, table._staged_at)


def row_key(*cols: str) -> Column:
    """A key made from a row's content, so that null or repeated ids never mix rows of different content."""
    return F.xxhash64(*[F.col(c) for c in cols])


def pieces_for(rows: int, per_piece: int) -> int:
    return max(1, math.ceil(rows / per_piece))



def ship(spark: SparkSession, payload: bytes, label: str) -> str:
    """Write ``payload`` to the shared folder and have every executor fetch it; tasks open it by the returned name."""
    name = f"{label}-{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/staged/{name}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(payload))
    finally:
        out.close()
    spark.sparkContext.addFile(path)
    return name
