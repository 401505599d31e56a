"""File trees as tables."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchweave.functions.paths import IMAGE_EXTENSIONS, is_image
from benchweave.session import cut_lineage

LISTED = "path string, bytes long, folder boolean"


def _local(root: str) -> str:
    """``root`` without the scheme of local files; local paths become absolute."""
    if root.startswith("file:"):
        root = "/" + root[len("file:") :].lstrip("/")
    return root if "://" in root else os.path.abspath(root)


def _list_folders(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = store.get_file_info(fs.FileSelector(folder))
                # Folders behind links are left out, so that no loop is followed.
                kept = [i for i in found if not (i.type == fs.FileType.Directory and isinstance(store, fs.LocalFileSystem) and os.path.islink(i.path))]
                columns = [[i.path for i in kept], [i.size for i in kept], [i.type == fs.FileType.Directory for i in kept]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.bool_()), strict=True)], ["path", "bytes", "folder"])

    return run


def scan_files(spark: SparkSession, root: str, extensions: Iterable[str] = IMAGE_EXTENSIONS) -> DataFrame:
    """path, rel_path, bytes of all files below ``root`` with a wanted suffix (any case), hidden and empty ones too.

    The tree is listed level by level; the folders of a level are shared out over tasks and each level is kept on shared
    storage, so the number of jobs is the depth of the tree. Only names and sizes are read. A missing root is an error.
    """
    root = _local(root.rstrip("/") or "/")
    store, top = fs.FileSystem.from_uri(root)
    if store.get_file_info(top).type != fs.FileType.Directory:
        raise FileNotFoundError(root)
    prefix = root.removesuffix(top) if "://" in root else ""
    folders = spark.createDataFrame([(top,)], "path string")
    found = spark.createDataFrame([], LISTED)
    while True:
        level = cut_lineage(folders.mapInArrow(_list_folders(root), LISTED))
        found = found.unionByName(level.where("not folder"))
        folders = level.where("folder").select("path").repartition(spark.sparkContext.defaultParallelism, "path")
        if level.where("folder").isEmpty():
            break
    below = len(top.rstrip("/")) + 2
    rows = found.select(F.concat(F.lit(prefix), "path").alias("path"), F.substring("path", below, 1_000_000).alias("rel_path"), "bytes")
    return rows.where(is_image("rel_path", tuple(extensions)))
