"""From file listings to manifests: enrich, parse, match, project; and output names for rewritten files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchweave.functions import paths as P
from benchweave.functions.names import canonical_name, non_blank, sanitize_meta, sanitize_name
from benchweave.operators.matching import annotate_raw_first, attach, match_names
from benchweave.operators.ranking import row_numbers
from benchweave.schemas import MANIFEST_COLUMNS
from benchweave.session import cut_lineage, keep_table, small_side


def normalize_log(log: DataFrame, root: str) -> DataFrame:
    """One cleaned row per processed path, with its absolute key and its key below ``root`` (NULL outside).

    ``position`` (file order) decides when a path was logged twice: the last entry wins.
    """
    base = root.rstrip("/") + "/"
    columns = set(log.columns)
    text = lambda c: F.col(c) if c in columns else F.lit("")
    path = F.trim(F.coalesce("processed_path", F.lit("")))
    clean = log.select(
        path.alias("abs_key"),
        F.when(path.startswith(base), F.substring(path, len(base) + 1, 1_000_000)).alias("rel_key"),
        (F.col("position") if "position" in columns else F.lit(0)).cast("bigint").alias("position"),
        F.struct(
            sanitize_meta(text("phase")).alias("phase"),
            sanitize_name(text("raw_species_folder_name")).alias("folder"),
            sanitize_name(text("raw_species_name")).alias("raw"),
            canonical_name(text("corrected_species_name")).alias("corrected"),
        ).alias("entry"),
    )
    return clean.where(F.col("abs_key") != "")


def _last_entry(log: DataFrame, key: str, name: str) -> DataFrame:
    rows = log.where(F.col(key).isNotNull())
    return rows.groupBy(key).agg(F.max_by("entry", F.struct("position", "abs_key")).alias(name))


def enrich_from_log(files: DataFrame, log: DataFrame) -> DataFrame:
    """Files with their log ``entry``: by absolute path, else by relative path (two equi-joins, no OR)."""
    absolute = _last_entry(log, "abs_key", "_abs")
    relative = _last_entry(log, "rel_key", "_rel")
    out = files.join(absolute, files["path"] == absolute["abs_key"], "left").drop("abs_key")
    out = out.join(relative, out["rel_path"] == relative["rel_key"], "left").drop("rel_key")
    return out.withColumn("entry", F.coalesce("_abs", "_rel")).drop("_abs", "_rel")


def project_manifest(df: DataFrame) -> DataFrame:
    """The fixed manifest columns, blank where a column is missing or NULL."""
    have = set(df.columns)
    return df.select(
        *[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")).alias(c) for c in MANIFEST_COLUMNS]
    )


def _manifest(rows: DataFrame, matches: DataFrame, on: list[str], dataset: str, modality: str, view: str, root: str, output_root: str | None) -> DataFrame:
    joined = attach(rows, matches, on)
    full = joined.withColumns(
        {
            "image_path": P.join_path(output_root or root, "rel_path"),
            "image_rel_path": F.col("rel_path"),
            "dataset_name": F.lit(dataset),
            "modality": F.lit(modality),
            "view": F.lit(view),
            "species": F.col("normalized_species_name"),
            "specimen_id": P.specimen_of("rel_path", F.col("_folder")),
            "source_id": P.source_id(dataset, "rel_path"),
        }
    )
    return project_manifest(full)


def macro_manifest(
    files: DataFrame,
    catalogue: DataFrame,
    corrections: DataFrame | None = None,
    log: DataFrame | None = None,
    root: str = "/data/macro",
    output_root: str | None = None,
    dataset: str = "macro",
    view: str = "cross_section_end_grain",
    scorer: str | None = "gestalt",
) -> DataFrame:
    """Nested tree (numbered entity folders) with log enrichment; no genus fallback. ``files``: path, rel_path."""
    rows = enrich_from_log(files, log) if log is not None else files.withColumn("entry", F.lit(None).cast("struct<phase:string,folder:string,raw:string,corrected:string>"))
    folder = P.entity_folder("rel_path")
    parent = F.coalesce(F.element_at(F.concat(F.array(F.lit("")), P.directories("rel_path")), -1), F.lit(""))
    rows = rows.withColumn("_own", folder).withColumn("_parent", parent)
    raw = F.coalesce(non_blank("entry.raw"), non_blank(P.entity_label(F.col("_own"))), F.col("_parent"))
    rows = rows.withColumns(
        {
            "_raw": raw,
            "_given": F.coalesce("entry.corrected", F.lit("")),
            "_folder": F.coalesce("_own", non_blank("entry.folder"), F.col("_parent")),
            "phase": P.phase_of("rel_path", F.col("entry.phase")),
        }
    ).select("rel_path", "_raw", "_given", "_folder", "phase")
    # Names are matched from these rows and joined back to them: with a log, two large joins need not run twice.
    rows = cut_lineage(rows) if log is not None else rows
    matches = match_names(rows, catalogue, corrections, "_raw", "_given", genus_fallback=False, scorer=scorer)
    return _manifest(rows, matches, ["_raw", "_given"], dataset, "macro", view, root, output_root)


def micro_manifest(
    files: DataFrame,
    catalogue: DataFrame,
    corrections: DataFrame | None = None,
    root: str = "/data/micro",
    output_root: str | None = None,
    dataset: str = "micro",
    view: str = "transversal_semi_thin_section",
    scorer: str | None = "gestalt",
) -> DataFrame:
    """Flat tree: the first folder names the entity; genus fallback is on and there is no phase."""
    first = F.substring_index(F.col("rel_path"), "/", 1)
    rows = files.select("rel_path", first.alias("_folder"), first.alias("_raw"))
    matches = match_names(rows, catalogue, corrections, "_raw", genus_fallback=True, scorer=scorer)
    return _manifest(rows, matches, ["_raw"], dataset, "micro", view, root, output_root)


def union_sources(sources: dict[str, DataFrame], tag: str = "phase") -> DataFrame:
    """Rows of several roots, each carrying its literal tag."""
    out = None
    for name, df in sources.items():
        tagged = df.withColumn(tag, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sources given")
    return out


def plan_outputs(files: DataFrame, catalogue: DataFrame, corrections: DataFrame) -> DataFrame:
    """Files whose entity folder is in the catalogue, annotated and with collision-free output names."""
    folder = P.entity_folder("rel_path")
    rows = files.withColumn("raw_species_folder_name", F.coalesce(folder, F.lit(""))).withColumn("raw_species_name", P.entity_label(folder))
    notes = annotate_raw_first(rows, catalogue, corrections, "raw_species_name")
    return output_names(attach(rows, notes, ["raw_species_name"]).where(F.col("in_catalogue") == 1))


def output_names(files: DataFrame, partition: tuple[str, ...] = (), suffix: str = ".jpg") -> DataFrame:
    """Output path per file: names that collide carry their old suffix, remaining collisions a running number.

    Collisions are counted with an aggregate and joined back, and running numbers are bucketed, so one name shared
    by very many files is no single task's work. Scan order is path order within ``partition``.
    """
    keys = list(partition)
    bare = files.withColumn("_plain", F.concat(P.drop_suffix("rel_path"), F.lit(suffix)))
    counts = bare.groupBy(*keys, "_plain").agg(F.count(F.lit(1)).alias("_n"))
    clashes = counts.where(F.col("_n") > 1)
    marked = bare.join(clashes, [*keys, "_plain"], "left")
    token = F.coalesce(non_blank(F.regexp_replace(P.extension("rel_path"), r"^\.", "")), F.lit("img"))
    renamed = F.concat(P.drop_suffix("rel_path"), F.lit("__from_"), token, F.lit(suffix))
    named = marked.withColumn("_name", F.when(F.col("_n").isNotNull(), renamed).otherwise(F.col("_plain")))
    named = keep_table(named.drop("_plain", "_n"))
    # Only names that several files still share are numbered; the rest is neither ordered nor sampled.
    shared = cut_lineage(named.groupBy(*keys, "_name").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).drop("_n"))
    same = [named[k].eqNullSafe(shared[k]) for k in [*keys, "_name"]]
    single = named.join(small_side(shared), same, "left_anti").withColumn("output_path", F.col("_name"))
    numbered = row_numbers(named.join(small_side(shared), same, "left_semi"), [*keys, "_name"], ["rel_path"], "_dup")
    final = F.when(
        F.col("_dup") > 1, F.concat(P.drop_suffix("_name"), F.lit("__dup"), F.col("_dup").cast("string"), F.lit(suffix))
    ).otherwise(F.col("_name"))
    return single.unionByName(numbered.withColumn("output_path", final).drop("_dup")).drop("_name")


def missing_outputs(planned: DataFrame, existing: DataFrame, on: str = "output_path") -> DataFrame:
    """Work still to do: planned outputs that do not exist yet."""
    return planned.join(existing.select(on), on, "left_anti")


def manifest_sort_keys() -> list[Column]:
    return [F.col(c) for c in ("dataset_name", "modality", "phase", "protocol_group", "species", "image_path")]


def sort_manifest(df: DataFrame) -> DataFrame:
    return df.orderBy(*manifest_sort_keys())


def sort_split(df: DataFrame) -> DataFrame:
    return df.orderBy("species", "modality", "phase", "image_path")
