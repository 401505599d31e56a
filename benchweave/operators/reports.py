"""Counts and summaries over manifests, logs and file availability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchweave.functions.names import tokens
from benchweave.functions.paths import join_path
from benchweave.operators.filters import is_uncertain, status_class
from benchweave.operators.ranking import row_numbers, running_total
from benchweave.schemas import MANIFEST_COLUMNS, MODALITIES, OVERLAP_COLUMNS, PROTOCOLS, UNCERTAIN_COLUMNS
from benchweave.session import cut_lineage


def count_if(condition: Column) -> Column:
    return F.count_if(condition)


def uncertain_matches(manifest: DataFrame) -> DataFrame:
    """Row count per match signature, kept where the match is not certain. Filtered before it is grouped."""
    signature = UNCERTAIN_COLUMNS[:-1]
    return manifest.where(is_uncertain()).groupBy(*signature).agg(F.count(F.lit(1)).alias("image_count"))


def overlap_report(manifest: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Per catalogue record: macro rows, exact micro rows, and micro rows known only by genus."""
    matched = manifest.where(F.col("matched_species_name") != "").groupBy("matched_species_name").agg(
        count_if(F.col("modality") == "macro").alias("_macro"), count_if(F.col("modality") == "micro").alias("_micro")
    )
    related = manifest.where((F.col("modality") == "micro") & (F.col("taxonomy_match_status") == "genus_match_only"))
    named = related.groupBy("genus", "species").agg(F.count(F.lit(1)).alias("_n"))
    by_genus = named.groupBy("genus").agg(
        F.count(F.lit(1)).alias("_names"),
        F.sum("_n").alias("_images"),
        F.concat_ws("|", F.array_sort(F.collect_list("species"))).alias("_list"),
    )
    out = catalogue.join(matched, catalogue["species"] == matched["matched_species_name"], "left").join(by_genus, "genus", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return out.select(
        "species",
        "genus",
        "family",
        "protocol_group",
        "overlap_type",
        "protocol_usage",
        zero(F.col("_macro")).alias("macro_image_count"),
        zero(F.col("_micro")).alias("micro_exact_image_count"),
        zero(F.col("_names")).alias("micro_genus_related_species_count"),
        zero(F.col("_images")).alias("micro_genus_related_image_count"),
        F.coalesce("_list", F.lit("")).alias("micro_genus_related_species"),
        (zero(F.col("_macro")) > 0).cast("int").alias("macro_present"),
        (zero(F.col("_micro")) > 0).cast("int").alias("micro_exact_present"),
    ).select(*OVERLAP_COLUMNS)


def group_counts(manifest: DataFrame, column: str = "protocol_group", blank: str | None = None) -> DataFrame:
    """Rows per group; blanks are dropped, or counted under the given label."""
    rows = manifest.where(F.col(column) != "") if blank is None else manifest.withColumn(column, F.when(F.col(column) == "", blank).otherwise(F.col(column)))
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("image_count"))


def name_profile(manifest: DataFrame) -> DataFrame:
    """Every distinct name combination with its row count: the small table all summary figures come from."""
    return manifest.groupBy(
        "modality", "raw_species_name", "normalized_species_name", "matched_species_name", "taxonomy_match_status", "protocol_group", "protocol_usage"
    ).agg(F.count(F.lit(1)).alias("n"))


def taxonomy_summary(profile: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(section, item, value) rows: counts per modality, per group and per protocol, catalogue coverage."""
    matched = F.when(F.col("matched_species_name") != "", F.col("matched_species_name"))
    genus_only = F.when(F.col("taxonomy_match_status") == "genus_match_only", F.col("normalized_species_name"))
    extra = F.when(
        F.when(F.col("modality") == "macro", F.col("matched_species_name") == "").otherwise(F.col("protocol_usage") == ""),
        F.col("normalized_species_name"),
    )
    figures = {
        "image_count": F.sum("n"),
        "species_before_normalization": F.count_distinct("raw_species_name"),
        "species_after_normalization": F.count_distinct("normalized_species_name"),
        "species_matched": F.count_distinct(matched),
        "genus_only_species": F.count_distinct(genus_only),
        "extra_species": F.count_distinct(extra),
    }
    wide = profile.groupBy("modality").agg(*[v.cast("bigint").alias(k) for k, v in figures.items()])
    per_modality = wide.unpivot("modality", list(figures), "item", "value").withColumnRenamed("modality", "section")
    size = catalogue.agg(F.count_distinct("species").alias("n"))
    found = profile.where(F.col("matched_species_name") != "").select("modality", "matched_species_name").distinct()
    names = catalogue.select("species").distinct()
    flags = names.join(
        found.groupBy("matched_species_name").agg(*[F.max((F.col("modality") == m).cast("int")).alias(m) for m in MODALITIES]),
        F.col("species") == F.col("matched_species_name"),
        "left",
    )
    cover = flags.agg(
        F.count(F.lit(1)).alias("final_species"),
        count_if(F.col("matched_species_name").isNotNull()).alias("species_matched"),
        *[count_if(F.coalesce(F.col(m), F.lit(0)) == 0).alias(f"missing_from_{m}") for m in MODALITIES],
    ).withColumn("section", F.lit("catalogue"))
    coverage = cover.unpivot("section", ["final_species", "species_matched", *[f"missing_from_{m}" for m in MODALITIES]], "item", "value")
    groups = profile.where((F.col("modality") == "macro") & (F.col("protocol_group") != "")).groupBy("protocol_group").agg(F.sum("n").alias("value"))
    group_rows = groups.select(F.lit("macro_groups").alias("section"), F.col("protocol_group").alias("item"), "value")
    protocols = profile.agg(
        *[F.coalesce(F.sum(F.when(F.array_contains(tokens("protocol_usage"), p), F.col("n"))), F.lit(0)).alias(p) for p in PROTOCOLS]
    ).withColumn("section", F.lit("protocols"))
    protocol_rows = protocols.unpivot("section", list(PROTOCOLS), "item", "value")
    return per_modality.unionByName(coverage).unionByName(group_rows).unionByName(protocol_rows)


def taxonomy_names(profile: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The sorted name lists beside ``taxonomy_summary``: (section, kind, position from 1, name), one row per name.

    Kinds are ``extra_species`` and ``genus_only_species`` per modality, and ``missing_species``: catalogue names without
    a matched row in the modality. Positions come from bucketed ranks, so a list may be of any length.
    """
    name = F.col("normalized_species_name")
    outside = F.when(F.col("modality") == "macro", F.col("matched_species_name") == "").otherwise(F.col("protocol_usage") == "")
    kinds = F.array_compact(
        F.array(F.when(outside, F.lit("extra_species")), F.when(F.col("taxonomy_match_status") == "genus_match_only", F.lit("genus_only_species")))
    )
    rows = profile.where(name.isNotNull()).select(F.col("modality").alias("section"), F.explode(kinds).alias("kind"), name.alias("name"))
    for modality in MODALITIES:
        lost = missing_names(catalogue, profile, modality)
        rows = rows.unionByName(lost.select(F.lit(modality).alias("section"), F.lit("missing_species").alias("kind"), F.col("species").alias("name")))
    named = cut_lineage(rows.distinct())
    return row_numbers(named, ["section", "kind"], ["name"], "position").select("section", "kind", "position", "name")


def missing_names(catalogue: DataFrame, manifest: DataFrame, modality: str) -> DataFrame:
    """Catalogue names with no matched row in the modality."""
    seen = manifest.where((F.col("modality") == modality) & (F.col("matched_species_name") != ""))
    return catalogue.select("species").distinct().join(seen.select(F.col("matched_species_name").alias("species")).distinct(), "species", "left_anti")


def matched_names(manifest: DataFrame) -> DataFrame:
    """Matched names over both modalities, each once."""
    rows = manifest.where(F.col("matched_species_name") != "")
    macro = rows.where(F.col("modality") == "macro").select(F.col("matched_species_name").alias("species"))
    micro = rows.where(F.col("modality") == "micro").select(F.col("matched_species_name").alias("species"))
    return macro.distinct().union(micro.distinct()).distinct()


def shared_genera(manifest: DataFrame) -> DataFrame:
    rows = manifest.where(F.col("genus") != "")
    return rows.where(F.col("modality") == "macro").select("genus").intersect(rows.where(F.col("modality") == "micro").select("genus"))


def run_stats(log: DataFrame) -> DataFrame:
    """One row: files, outcomes, bytes in and out."""
    kind = status_class()
    return log.agg(
        F.count(F.lit(1)).alias("files_found"),
        *[count_if(kind == k).alias(k) for k in ("processed", "skipped", "failed")],
        F.coalesce(F.sum("original_bytes"), F.lit(0)).alias("total_original_bytes"),
        F.coalesce(F.sum("new_bytes"), F.lit(0)).alias("total_output_bytes"),
    )


def run_breakdown(log: DataFrame) -> DataFrame:
    """(dimension, item, n) counts by phase, catalogue flag and group, in one pass over the log."""
    group = F.when(F.coalesce("protocol_group", F.lit("")) == "", "unmatched").otherwise(F.col("protocol_group"))
    pairs = F.array(
        F.struct(F.lit("phase").alias("dimension"), F.col("phase").cast("string").alias("item")),
        F.struct(F.lit("in_catalogue").alias("dimension"), F.col("in_catalogue").cast("string").alias("item")),
        F.struct(F.lit("protocol_group").alias("dimension"), group.alias("item")),
    )
    small = log.groupBy("phase", "in_catalogue", "protocol_group").agg(F.count(F.lit(1)).alias("_n"))
    exploded = small.select(F.explode(pairs).alias("_p"), "_n")
    return exploded.groupBy("_p.dimension", "_p.item").agg(F.sum("_n").alias("n"))


def check_availability(required: DataFrame, files: DataFrame, on: str, size: str = "bytes") -> DataFrame:
    """Required rows with ``present`` and the size of the file found."""
    found = files.groupBy(on).agg(F.max(size).alias("found_bytes"))
    joined = required.join(found.withColumn("_here", F.lit(1)), on, "left")
    return joined.withColumn("present", F.coalesce("_here", F.lit(0))).drop("_here")


def checked_path(root: str) -> Column:
    """Where a manifest row is looked for: below ``root`` when it has a relative path, else its stored path."""
    rel = F.trim(F.coalesce("image_rel_path", F.lit("")))
    return F.when(rel != "", join_path(root, rel)).otherwise(F.trim("image_path"))


def missing_rows(required: DataFrame, files: DataFrame, on: str) -> DataFrame:
    return required.join(files.select(on), on, "left_anti")


def availability_summary(checked: DataFrame, entity: str) -> DataFrame:
    total, present = F.count(F.lit(1)), F.sum("present")
    return checked.agg(
        total.alias("required"),
        present.cast("bigint").alias("present"),
        (total - present).cast("bigint").alias("missing"),
        (present * 100.0 / total).alias("present_pct"),
        F.coalesce(F.sum("found_bytes"), F.lit(0)).alias("present_bytes"),
        F.count_distinct(entity).alias("entities_checked"),
        F.count_distinct(F.when(F.col("present") == 0, F.col(entity))).alias("entities_missing"),
    )


def missing_sample(required: DataFrame, files: DataFrame, on: str, n: int) -> DataFrame:
    """The first ``n`` missing rows by key: a report, taken as a top-n."""
    return missing_rows(required, files, on).orderBy(on).limit(max(0, n))


def dataset_summary(manifest: DataFrame) -> DataFrame:
    """(item, value): samples, entities, rows per modality and per protocol group."""
    small = manifest.groupBy("species", "modality", "protocol_group").agg(F.count(F.lit(1)).alias("n"))
    head = small.agg(F.sum("n").alias("samples"), F.count_distinct("species").alias("species")).withColumn("_s", F.lit(""))
    out = head.unpivot("_s", ["samples", "species"], "item", "value").drop("_s")
    for column in ("modality", "protocol_group"):
        part = small.where(F.col(column) != "").groupBy(column).agg(F.sum("n").alias("value"))
        out = out.union(part.select(F.concat(F.lit(column + "="), F.col(column)).alias("item"), "value"))
    return out


def index_lists(indexed: DataFrame, keys: list[str], index: str = "row_index", chunk: int = 8192) -> DataFrame:
    """Sorted index lists per key, cut into pieces of at most ``chunk`` so that no row holds a whole group."""
    piece = F.floor(F.col(index) / F.lit(chunk)).cast("bigint")
    grouped = indexed.groupBy(*keys, piece.alias("chunk"))
    return grouped.agg(F.sort_array(F.collect_list(index)).alias("indices"))


def pairing_stats(manifest: DataFrame) -> DataFrame:
    """One row: rows and entities per modality, entities and genera present in both."""
    per_entity = manifest.groupBy("species", "genus").agg(*[count_if(F.col("modality") == m).alias(m) for m in MODALITIES])
    species = per_entity.groupBy("species").agg(*[F.sum(m).alias(m) for m in MODALITIES])
    genera = per_entity.where(F.col("genus") != "").groupBy("genus").agg(*[F.sum(m).alias(m) for m in MODALITIES])
    both = (F.col("macro") > 0) & (F.col("micro") > 0)
    left = species.agg(
        F.sum("macro").alias("macro_samples"),
        F.sum("micro").alias("micro_samples"),
        count_if(F.col("macro") > 0).alias("macro_species"),
        count_if(F.col("micro") > 0).alias("micro_species"),
        count_if(both).alias("paired_species"),
    )
    right = genera.agg(count_if(both).alias("shared_genera"))
    return left.join(right)


def pairing_problems(stats: DataFrame, uses_contrast: bool = True, uses_genus: bool = True) -> list[str]:
    """What stands in the way of aligning both modalities; reads the one-row table of ``pairing_stats``."""
    row = stats.first()
    problems = []
    if not row["macro_samples"] or not row["micro_samples"]:
        problems.append("both modalities need samples")
    if uses_contrast and not row["paired_species"]:
        problems.append("no entity has samples in both modalities")
    if uses_genus and not row["shared_genera"]:
        problems.append("no genus is shared by both modalities")
    return problems


def label_index(manifest: DataFrame, column: str = "species", out: str = "label") -> DataFrame:
    """Distinct non-blank names in order, numbered from zero."""
    names = manifest.select(F.trim(F.col(column)).alias(column)).where(F.col(column) != "").distinct()
    return running_total(names, [], [column], None, "_rn").select(column, (F.col("_rn") - 1).alias(out))


def attach_labels(manifest: DataFrame, labels: DataFrame, column: str = "species") -> DataFrame:
    return manifest.join(labels, column)


def uncovered_labels(manifest: DataFrame, labels: DataFrame, column: str = "species") -> DataFrame:
    """Entities the label table misses; a reader must refuse the data unless this is empty."""
    return manifest.select(column).distinct().join(labels.select(column), column, "left_anti")


def require_covered(manifest: DataFrame, labels: DataFrame, column: str = "species") -> None:
    """Fail with the number of uncovered entities; ``uncovered_labels`` is the table of all of them."""
    gaps = uncovered_labels(manifest, labels, column)
    found = gaps.agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("first")).first()
    if found["n"]:
        raise ValueError(f"label table does not cover {found['n']} entities, the first is {found['first']}")


def dense_fill(counts: DataFrame, entities: DataFrame, keys: DataFrame, values: list[str]) -> DataFrame:
    """Every entity with every key (a handful, such as the splits), zero where nothing was counted.

    The key rows are packed into one literal-sized array and exploded per entity: no cross join is planned.
    """
    columns = keys.columns
    packed = [F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, row)]) for row in keys.collect()]
    grid = entities.withColumn("_k", F.explode(F.array(*packed))).select(*entities.columns, *[F.col(f"_k.{c}").alias(c) for c in columns])
    full = grid.join(counts, [*entities.columns, *columns], "left")
    return full.select(*grid.columns, *[F.coalesce(F.col(v), F.lit(0)).alias(v) for v in values])


def manifest_columns() -> list[str]:
    return list(MANIFEST_COLUMNS)
