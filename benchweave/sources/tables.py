"""Delimited tables: catalogue, corrections, logs and manifests."""

from __future__ import annotations

import csv
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchweave.functions.names import DEFAULT_CORRECTIONS, pipe_list
from benchweave.operators.matching import prepare_catalogue
from benchweave.operators.ranking import dense_index
from benchweave.session import cut_lineage
from benchweave.sources.framing import ORDER, csv_records

# Headers under which a correction table may name its two columns, first match wins.
CORRECTION_SOURCE_HEADERS = (
    "raw_species_name",
    "raw_name",
    "raw",
    "typo",
    "source",
    "incorrect_name",
    "input_species",
)
CORRECTION_TARGET_HEADERS = (
    "corrected_species_name",
    "corrected_name",
    "corrected",
    "canonical_name",
    "canonical",
    "target",
    "species",
    "matched_species_name",
)
CATALOGUE_REQUIRED = ("species", "genus", "group", "overlap_type", "protocol_usage")


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, multiline: bool = True, header: bool = True) -> DataFrame:
    """Header CSV with every value as text and blanks as "". ``columns`` gives the header up front, so nothing is probed.

    Quoted line breaks stay in their record, for which a file is read as a whole. Files known to hold none are read in
    pieces with ``multiline=False``.
    """
    reader = spark.read.option("header", header).option("escape", '"').option("multiLine", multiline)
    if columns is not None:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).option("enforceSchema", False)
    return reader.csv(path).na.fill("")


def read_split_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """``read_table`` of large files in pieces, quoted line breaks included, with ``position`` in reading order.

    All files must have one header. ``columns`` names the columns that the header must hold, in this order.
    """
    records = cut_lineage(csv_records(spark, path))
    first = records.groupBy("file").agg(F.min(F.struct(*ORDER, "value")).alias("_h"))
    headers = [r["value"] for r in first.select("_h.value").distinct().limit(2).collect()]
    if not headers:
        return spark.createDataFrame([], T.StructType([*(T.StructField(c, T.StringType()) for c in columns or []), T.StructField("position", T.LongType())]))
    names = next(csv.reader([headers[0]]))
    if len(headers) > 1 or len(set(names)) < len(names) or (columns is not None and names != list(columns)):
        raise ValueError(f"unequal or unexpected headers: {headers}")
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    body = records.join(first, "file").where((F.col("block") != F.col("_h.block")) | (F.col("at") != F.col("_h.at")))
    parsed = body.select("file", *ORDER, F.from_csv("value", schema, {"escape": '"', "maxCharsPerColumn": "-1"}).alias("r"))
    numbered = dense_index(parsed, ["file", *ORDER], "position")
    return numbered.select(*[F.coalesce(F.col("r").getField(n), F.lit("")).alias(n) for n in names], "position")


def with_row_order(table: DataFrame, out: str = "position") -> DataFrame:
    """Dense row numbers in reading order, exact over any number of files and tasks: by path, then by place in the file."""
    marked = table.select(
        *table.columns,
        F.col("_metadata.file_path").alias("_f"),
        F.col("_metadata.file_block_start").alias("_b"),
        F.monotonically_increasing_id().alias("_m"),
    )
    return dense_index(marked, ["_f", "_b", "_m"], out).drop("_f", "_b", "_m")


def read_catalogue(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    table = read_table(spark, path)
    if strict:
        require_columns(table, CATALOGUE_REQUIRED)
    return prepare_catalogue(with_row_order(table))


def pick_header(columns: Iterable[str], aliases: Iterable[str]) -> str | None:
    have = set(columns)
    return next((a for a in aliases if a in have), None)


def correction_rows(table: DataFrame, *keep: str) -> DataFrame:
    """(raw_name, corrected_name) picked by header alias, and the columns to ``keep``."""
    source, target = pick_header(table.columns, CORRECTION_SOURCE_HEADERS), pick_header(table.columns, CORRECTION_TARGET_HEADERS)
    if source is None or target is None:
        raise ValueError("the correction table needs one source and one target column")
    return table.select(F.col(source).alias("raw_name"), F.col(target).alias("corrected_name"), *keep)


def load_corrections(spark: SparkSession, path: str | None = None, defaults: Mapping[str, str] | None = DEFAULT_CORRECTIONS, headerless: bool = False) -> DataFrame:
    """Defaults first, then the file; ``position`` lets later entries win.

    With ``headerless``, a file without known headers holds data from its first row on, in its first two columns.
    """
    schema = "raw_name string, corrected_name string, position bigint"
    base = spark.createDataFrame([(k, v, i - len(defaults or {})) for i, (k, v) in enumerate((defaults or {}).items())], schema)
    if path is None:
        return base
    table = read_table(spark, path)
    known = pick_header(table.columns, CORRECTION_SOURCE_HEADERS) and pick_header(table.columns, CORRECTION_TARGET_HEADERS)
    if headerless and not known and len(table.columns) >= 2:
        table = read_table(spark, path, header=False).withColumnsRenamed({"_c0": "raw_name", "_c1": "corrected_name"})
    table = with_row_order(table, "_position")
    return base.unionByName(correction_rows(table, "_position").withColumnRenamed("_position", "position"))


def read_log(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """A processing log with its row position, for ``manifest.normalize_log``."""
    return with_row_order(require_columns(read_table(spark, path, multiline=multiline), ["processed_path"]))


def read_manifest(spark: SparkSession, path: str, numbered: bool = False, multiline: bool = True) -> DataFrame:
    """A manifest with its suggestions as an array; ``numbered`` adds dense row numbers over all files."""
    table = read_table(spark, path, multiline=multiline)
    if numbered:
        table = with_row_order(table, "row_index")
    if "taxonomy_suggestions" in table.columns:
        table = table.withColumn("taxonomy_suggestions", pipe_list("taxonomy_suggestions"))
    return table
