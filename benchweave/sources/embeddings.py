"""Embedding tables in the three shapes they arrive in: records, parallel arrays, wide columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchweave.functions.vectors import FEATURE_COLUMNS
from benchweave.operators.ranking import row_numbers
from benchweave.schemas import EMBEDDING_SCHEMA, MODALITIES
from benchweave.session import cut_lineage
from benchweave.sources.framing import ORDER, json_records

# Names under which the parts of a parallel-array file may be stored, first match wins.
VECTOR_KEYS = ("{m}_embeddings", "{m}_emb", "{m}", "z_{m}", "{m}_z")
LABEL_KEYS = ("{m}_labels", "{m}_species", "species_{m}", "labels_{m}")
GENUS_KEYS = {"macro": ("macro_genus", "macro_genera", "genus_macro"), "micro": ("micro_genus", "micro_genera", "genus_micro")}
ID_KEYS = ("{m}_image_paths", "{m}_paths", "image_paths_{m}", "{m}_ids")
WIDE_PREFIXES = ("embedding_", "feature_", "dim_")
META_COLUMNS = ("split", "modality", "species", "genus", "image_path")


def read_records(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """JSON records: a list, an object that begins with ``records``, or (``lines``) one record per line.

    All forms split across tasks (``framing``), one large list included. ``id`` is the record's path, or else its modality
    and its number among the records of that modality in reading order, counted from 0 over all files.
    """
    if lines:
        records = spark.read.schema(EMBEDDING_SCHEMA).json(path)
        place = [F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m")]
        rows = records.select(*EMBEDDING_SCHEMA.names, *place)
    else:
        framed = json_records(spark, path).select("file", *ORDER, F.from_json("value", EMBEDDING_SCHEMA, {"mode": "FAILFAST"}).alias("r"))
        rows = framed.select("r.*", F.col("file").alias("_f"), F.col("block").alias("_b"), F.col("at").alias("_m"))
    rows = cut_lineage(rows.withColumn("_kind", F.coalesce("modality", F.lit(""))))
    numbered = row_numbers(rows, ["_kind"], ["_f", "_b", "_m"], "_n")
    ident = F.coalesce("image_path", F.concat("_kind", F.lit(":"), (F.col("_n") - 1).cast("string")))
    return numbered.select(ident.alias("id"), *EMBEDDING_SCHEMA.names)


def _first(columns, patterns, modality) -> str | None:
    return next((p.format(m=modality) for p in patterns if p.format(m=modality) in columns), None)


def from_parallel_arrays(df: DataFrame, feature: str = "embedding") -> DataFrame:
    """Long rows from rows that hold parallel arrays per modality (vectors, labels, optional genera and ids)."""
    have = set(df.columns)
    # One input row numbers its entries from 0; of several rows each adds its own mark, equal rows and retries alike.
    several = not df.offset(1).isEmpty()
    df = df.withColumn("_row", F.monotonically_increasing_id()) if several else df
    df = cut_lineage(df) if several else df
    out = None
    for m in MODALITIES:
        suffix = () if feature == "embedding" else ("{m}_embeddings_" + feature,)
        vectors, labels = _first(have, suffix + VECTOR_KEYS, m), _first(have, LABEL_KEYS, m)
        if vectors is None or labels is None:
            raise ValueError(f"no {m} vectors and labels among {sorted(have)}")
        genus, ids = _first(have, GENUS_KEYS[m], m), _first(have, ID_KEYS, m)
        fields = {"embedding": vectors, "species": labels, **({"genus": genus} if genus else {}), **({"id": ids} if ids else {})}
        checked = df.select(
            F.when(F.size(vectors) == F.size(labels), F.arrays_zip(*[F.col(c).alias(n) for n, c in fields.items()]))
            .otherwise(F.raise_error(F.lit(f"{m} vectors and labels differ in length")))
            .alias("z"),
            *(["_row"] if several else []),
        )
        rows = checked.select(F.posexplode("z").alias("pos", "r"), *(["_row"] if several else []))
        mark = F.concat(F.col("_row").cast("string"), F.lit(":")) if several else F.lit("")
        item = F.col("r.id").cast("string") if ids else F.concat(F.lit(f"{m}:"), mark, F.col("pos").cast("string"))
        part = rows.select(
            item.alias("id"),
            F.lit(m).alias("modality"),
            F.col("r.species").cast("string").alias("species"),
            (F.col("r.genus").cast("string") if genus else F.lit("")).alias("genus"),
            F.col("r.embedding").cast("array<float>").alias("embedding"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def vector_columns(df: DataFrame) -> list[str]:
    """Columns that make up the vector: by prefix, else every numeric column (or text that reads as numbers)."""
    named = [c for c in df.columns if c.startswith(WIDE_PREFIXES)]
    if named:
        return named
    others = [c for c in df.columns if c not in META_COLUMNS]
    numeric = [c for c in others if isinstance(df.schema[c].dataType, T.NumericType)]
    texts = [c for c in others if isinstance(df.schema[c].dataType, T.StringType)]
    if texts:
        first = df.select(*[F.col(c).try_cast("double").alias(c) for c in texts]).first()
        numeric = [c for c in others if c in numeric or (first is not None and c in texts and first[c] is not None)]
    if not numeric:
        raise ValueError("no vector columns found")
    return numeric


def from_wide(df: DataFrame, feature: str = "embedding") -> DataFrame:
    """One vector column out of many scalar columns; label and path aliases are accepted."""
    columns = vector_columns(df)
    have = set(df.columns)
    pick = lambda *names: next((F.col(n) for n in names if n in have), F.lit(""))
    return df.select(
        pick("modality").alias("modality"),
        pick("species", "label").cast("string").alias("species"),
        pick("genus").alias("genus"),
        pick("image_path", "path").alias("image_path"),
        F.array(*[F.col(c).cast("float") for c in columns]).alias(FEATURE_COLUMNS[feature]),
    )


def cached(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The embedding table at ``path``; computed and saved there first if it does not exist."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    done = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(done):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
