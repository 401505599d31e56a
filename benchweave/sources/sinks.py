"""Writers: fixed-column CSV, JSON reports, appended JSON lines, partitioned manifests and splits."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchweave.functions.names import tokens
from benchweave.operators import reports
from benchweave.operators.manifest import manifest_sort_keys, project_manifest
from benchweave.schemas import PROTOCOLS
from benchweave.session import keep_table

# A table, or what makes it from the written rows.
Report = DataFrame | Callable[[DataFrame], DataFrame]
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
FOLDERS_AT_ONCE = 16

# Values are kept as they are: the writer would otherwise trim blanks at the ends.
CSV_OPTIONS = {
    "header": "true",
    "escape": '"',
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    # A file whose fields may hold line breaks is read by one task: no file takes more records than this, all are written.
    "maxRecordsPerFile": "50000",
}
# Manifests repeat names and paths in every row, and their files are read whole anyhow.
PACKED = {**CSV_OPTIONS, "compression": "gzip"}


@contextmanager
def _open_folders(spark: SparkSession) -> Iterator[None]:
    """A task keeps the files of a few folders open side by side, instead of sorting its rows by folder first."""
    before = spark.conf.get(_WRITERS, None)
    spark.conf.set(_WRITERS, str(FOLDERS_AT_ONCE))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_WRITERS)
        else:
            spark.conf.set(_WRITERS, before)


def fixed_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exactly ``columns``: missing ones blank, arrays as pipe text."""
    kinds = dict(df.dtypes)

    def text(c: str) -> Column:
        if c not in kinds:
            return F.lit("")
        value = F.concat_ws("|", c) if kinds[c].startswith("array") else F.col(c).cast("string")
        return F.coalesce(value, F.lit(""))

    return df.select(*[text(c).alias(c) for c in columns])


def write_csv(df: DataFrame, path: str, columns: Sequence[str], mode: str = "overwrite", partition_by: Sequence[str] = (), packed: bool = False) -> None:
    """Exactly ``columns`` of all rows. ``packed`` writes gzip files, for tables as long as the input."""
    writer = fixed_columns(df, columns).write.mode(mode).options(**(PACKED if packed else CSV_OPTIONS))
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def json_text(df: DataFrame) -> DataFrame:
    """One JSON text per row, keys in order."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).alias("value"))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    json_text(df).write.mode(mode).text(path)


def append_records(df: DataFrame, path: str) -> None:
    """Add records to a growing JSON-lines folder; committed files are never rewritten."""
    df.write.mode("append").json(path)


def summary_json(summary: DataFrame) -> DataFrame:
    """(section, item, value) rows as one nested object per section; keys in order."""
    per = summary.groupBy("section").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("item", "value")))).alias("figures"))
    return per.orderBy("section")


def by_protocol(manifest: DataFrame) -> DataFrame:
    """A row per protocol a sample belongs to."""
    wanted = F.array_intersect(tokens("protocol_usage"), F.array(*[F.lit(p) for p in PROTOCOLS]))
    return manifest.withColumn("protocol", F.explode(wanted))


def write_bundle(manifest: DataFrame, catalogue: DataFrame, root: str, ordered: bool = False) -> dict[str, str]:
    """Manifests by modality and by protocol, plus overlap, uncertain and summary reports.

    The manifest is computed once and kept on shared storage; the five outputs read it from there. The two manifests are
    gzip files, which every CSV reader of Spark opens.
    """
    paths = {k: f"{root.rstrip('/')}/{k}" for k in ("by_modality", "by_protocol", "overlap", "uncertain", "summary")}
    rows = keep_table(project_manifest(manifest))
    rows = rows.orderBy(*manifest_sort_keys()) if ordered else rows
    with _open_folders(rows.sparkSession):
        rows.withColumn("part", F.col("modality")).write.mode("overwrite").options(**PACKED).partitionBy("part").csv(paths["by_modality"])
        by_protocol(rows).write.mode("overwrite").options(**PACKED).partitionBy("protocol").csv(paths["by_protocol"])
    write_csv(reports.overlap_report(rows, catalogue), paths["overlap"], reports.OVERLAP_COLUMNS)
    write_csv(reports.uncertain_matches(rows), paths["uncertain"], reports.UNCERTAIN_COLUMNS)
    write_json(summary_json(reports.taxonomy_summary(reports.name_profile(rows), catalogue)), paths["summary"])
    return paths


def write_splits(rows: DataFrame, protocol: str, root: str, summary: Report, class_counts: Report) -> dict[str, str]:
    """Split rows in protocol/split folders (only this protocol's are replaced; gzip files), with summary and class counts.

    Both reports may be tables, or functions that make them from the rows as written: then the rows are computed once,
    and no second copy of them is kept.
    """
    paths = {k: f"{root.rstrip('/')}/{k}" for k in ("splits", "summary", "class_counts")}
    options = {**PACKED, "partitionOverwriteMode": "dynamic"}
    tagged = rows.withColumn("protocol", F.lit(protocol))
    with _open_folders(rows.sparkSession):
        tagged.write.mode("overwrite").options(**options).partitionBy("protocol", "split").csv(paths["splits"])
    if callable(summary) or callable(class_counts):
        fields = [f for f in rows.schema.fields if f.name != "split"] + [f for f in rows.schema.fields if f.name == "split"]
        reader = rows.sparkSession.read.schema(T.StructType(fields)).options(header=True, escape='"', multiLine=True, enforceSchema=False)
        written = reader.option("basePath", paths["splits"]).csv(f"{paths['splits']}/protocol={protocol}")
        written = written.na.fill("").select(*rows.columns)
        summary, class_counts = (made(written) if callable(made) else made for made in (summary, class_counts))
    write_json(summary, f"{paths['summary']}/protocol={protocol}")
    write_csv(class_counts, f"{paths['class_counts']}/protocol={protocol}", class_counts.columns)
    return paths
