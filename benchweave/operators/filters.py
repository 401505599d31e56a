"""Row filters over manifests and logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchweave.functions.names import tokens
from benchweave.schemas import MODALITIES

# Reading modes and the modalities they admit.
MODES = {
    "macro_classification": ("macro",),
    "micro_classification": ("micro",),
    "joint_alignment": ("macro", "micro"),
}


def wanted_modalities(modality: str | Sequence[str] | None = None, mode: str = "joint_alignment") -> tuple[str, ...]:
    """Modalities a request admits; unknown modes, names or mixes are errors."""
    mode = mode.strip().lower()
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; expected one of {sorted(MODES)}")
    if modality is None:
        return MODES[mode]
    names = [modality] if isinstance(modality, str) else list(modality)
    wanted = sorted({n.strip().lower() for n in names if n.strip()})
    if isinstance(modality, str) and wanted == ["both"]:
        wanted = list(MODALITIES)
    unknown = [n for n in wanted if n not in MODALITIES]
    if unknown:
        raise ValueError(f"unknown modality filter {unknown}")
    if len(MODES[mode]) == 1 and tuple(wanted) != MODES[mode]:
        raise ValueError(f"mode {mode} only reads modality {MODES[mode][0]}")
    return tuple(wanted)


def filter_modality(df: DataFrame, modality=None, mode: str = "joint_alignment") -> DataFrame:
    return df.where(F.lower(F.trim("modality")).isin(*wanted_modalities(modality, mode)))


def filter_protocol(df: DataFrame, protocols: str | Sequence[str] | None) -> DataFrame:
    """Rows whose protocol tokens meet the wanted set; no wanted set keeps all."""
    names = [protocols] if isinstance(protocols, str) else list(protocols or ())
    wanted = sorted({n.strip().upper() for n in names if n and n.strip()})
    if not wanted:
        return df
    return df.where(F.arrays_overlap(tokens("protocol_usage"), F.array(*[F.lit(w) for w in wanted])))


def candidates(df: DataFrame, protocol: str) -> DataFrame:
    return df.where(F.array_contains(tokens("protocol_usage"), protocol))


def is_uncertain(status="taxonomy_match_status", suggestions="taxonomy_suggestions") -> Column:
    """Only a genus or close names were found, or suggestions exist whatever the status."""
    return F.col(status).isin("genus_match_only", "unmatched_with_close_candidates") | (F.col(suggestions) != "")


def rejects(df: DataFrame, row_index: str = "row_index") -> DataFrame:
    """Rows a reader must refuse, with their line number in the file (header is line 1)."""
    species = F.trim(F.coalesce("species", F.lit("")))
    located = (F.trim(F.coalesce("image_path", F.lit(""))) != "") | (F.trim(F.coalesce("image_rel_path", F.lit(""))) != "")
    reason = F.when(species == "", "missing species").when(~located, "missing path")
    return df.withColumn("reason", reason).where(F.col("reason").isNotNull()).withColumn("line", F.col(row_index) + 2)


def valid_rows(df: DataFrame) -> DataFrame:
    species = F.trim(F.coalesce("species", F.lit("")))
    located = (F.trim(F.coalesce("image_path", F.lit(""))) != "") | (F.trim(F.coalesce("image_rel_path", F.lit(""))) != "")
    return df.where((species != "") & located)


def status_class(status="status") -> Column:
    """processed, skipped (any status starting so) or failed (everything else)."""
    text = F.col(status)
    return F.when(text == "processed", "processed").when(text.startswith("skipped"), "skipped").otherwise("failed")


def in_catalogue(df: DataFrame, flag: str = "in_catalogue") -> DataFrame:
    return df.where(F.col(flag) == 1)
