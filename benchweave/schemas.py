"""Column lists and schemas of the tables the operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

# Table headers that readers of the written files rely on.
MANIFEST_COLUMNS = [
    "image_path",
    "image_rel_path",
    "dataset_name",
    "modality",
    "view",
    "species",
    "genus",
    "family",
    "specimen_id",
    "source_id",
    "phase",
    "raw_species_name",
    "normalized_species_name",
    "protocol_group",
    "overlap_type",
    "protocol_usage",
    "matched_species_name",
    "taxonomy_match_status",
    "taxonomy_suggestions",
]
OVERLAP_COLUMNS = [
    "species",
    "genus",
    "family",
    "protocol_group",
    "overlap_type",
    "protocol_usage",
    "macro_image_count",
    "micro_exact_image_count",
    "micro_genus_related_species_count",
    "micro_genus_related_image_count",
    "micro_genus_related_species",
    "macro_present",
    "micro_exact_present",
]
UNCERTAIN_COLUMNS = [
    "dataset_name",
    "modality",
    "raw_species_name",
    "normalized_species_name",
    "genus",
    "protocol_group",
    "overlap_type",
    "protocol_usage",
    "taxonomy_match_status",
    "matched_species_name",
    "taxonomy_suggestions",
    "image_count",
]
CLASS_COUNT_COLUMNS = [
    "protocol",
    "split",
    "species",
    "protocol_group",
    "total_samples",
    "groups_in_split",
    "macro_samples",
    "micro_samples",
    "phase1_macro_samples",
    "phase2_macro_samples",
    "present_in_split",
]
CATALOGUE_COLUMNS = ["species", "genus", "family", "group", "overlap_type", "protocol_usage", "group_order"]
SPLITS = ("train", "val", "test")
MODALITIES = ("macro", "micro")
PHASES = ("Phase1", "Phase2")
PROTOCOLS = ("P1", "P2", "P3")

EMBEDDING_SCHEMA = T.StructType(
    [
        T.StructField("split", T.StringType()),
        T.StructField("modality", T.StringType()),
        T.StructField("species", T.StringType()),
        T.StructField("genus", T.StringType()),
        T.StructField("image_path", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("projected_feature", T.ArrayType(T.FloatType())),
        T.StructField("pooled_feature", T.ArrayType(T.FloatType())),
    ]
)
