"""Names against a catalogue: exact, corrected, genus-level and close matches.

Names are matched once per distinct text, where plain joins are left to adaptive execution; the finished name table
joins back to the rows, broadcast only after its size was counted.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchweave.functions.names import canonical_name, genus_of, name_key, name_key_loose, non_blank, sanitize_meta, sanitize_name
from benchweave.operators.closeness import Measure, close_pairs
from benchweave.operators.ranking import top_rows
from benchweave.session import cut_lineage, small_side

# Thresholds, list length and the tags of a genus-only match.
GLOBAL_CUTOFF = 0.88
GENUS_CUTOFF = 0.72
MAX_SUGGESTIONS = 3
GENUS_ONLY_GROUP = "B"
GENUS_ONLY_OVERLAP = "genus_overlap_only"
GENUS_ONLY_PROTOCOLS = "P2,P3"
GROUP_ORDER = {"A": 0, "B": 1, "C": 2}
OTHER_GROUP_RANK = 999

RECORD = ["species", "genus", "family", "protocol_group", "overlap_type", "protocol_usage", "group_order", "position"]


def prepare_catalogue(df: DataFrame) -> DataFrame:
    """Clean catalogue records with their keys; ``position`` (file order) decides between equal keys."""
    columns = set(df.columns)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in columns else F.lit("")
    group = text("protocol_group") if "protocol_group" in columns else text("group")
    order = F.coalesce(F.trim(text("group_order")).try_cast("int"), F.lit(0))
    species = canonical_name(text("species"))
    given_genus = text("genus")
    out = df.select(
        species.alias("species"),
        canonical_name(F.coalesce(non_blank(given_genus), genus_of(text("species")))).alias("genus"),
        sanitize_meta(text("family")).alias("family"),
        sanitize_meta(group).alias("protocol_group"),
        sanitize_meta(text("overlap_type")).alias("overlap_type"),
        sanitize_meta(text("protocol_usage")).alias("protocol_usage"),
        order.alias("group_order"),
        (F.col("position") if "position" in columns else F.monotonically_increasing_id()).cast("bigint").alias("position"),
    )
    return out.where(F.col("species") != "").withColumn("species_key", F.lower("species")).withColumn("genus_key", F.lower("genus"))


def by_key(catalogue: DataFrame, key: str = "species_key", keep: str = "last") -> DataFrame:
    """One record per key: the last (or first) in file order."""
    pick = F.max_by if keep == "last" else F.min_by
    record = F.struct(*[c for c in catalogue.columns if c != key])
    return catalogue.groupBy(key).agg(pick(record, F.col("position")).alias("_r")).select(key, "_r.*")


def genus_table(catalogue: DataFrame) -> DataFrame:
    """Per genus: the one family all records agree on (else blank) and the first three names."""
    families = catalogue.groupBy("genus_key").agg(
        F.count_distinct(non_blank("family")).alias("_n"), F.max("family").alias("_family")
    )
    first = top_rows(catalogue, ["genus_key"], ["group_order", "species"], MAX_SUGGESTIONS)
    names = first.groupBy("genus_key").agg(F.array_sort(F.collect_list(F.struct("rn", "species"))).alias("_s"))
    return families.join(names, "genus_key").select(
        "genus_key",
        F.when(F.col("_n") == 1, F.col("_family")).otherwise("").alias("genus_family"),
        F.concat_ws("|", F.transform("_s", lambda s: s["species"])).alias("genus_names"),
    )


def sort_catalogue(catalogue: DataFrame) -> DataFrame:
    return catalogue.orderBy(group_rank("protocol_group"), "group_order", "species")


def group_rank(column: str) -> Column:
    out = F.lit(OTHER_GROUP_RANK)
    for name, rank in GROUP_ORDER.items():
        out = F.when(F.col(column) == name, rank).otherwise(out)
    return out


def correction_map(df: DataFrame) -> DataFrame:
    """(raw_key, corrected) from raw_name, corrected_name and an optional ``position``; the last entry wins."""
    position = F.col("position") if "position" in df.columns else F.lit(0)
    clean = df.select(
        name_key("raw_name").alias("raw_key"), canonical_name("corrected_name").alias("corrected"), position.alias("_p")
    ).where((F.col("raw_key") != "") & (F.col("corrected") != ""))
    return clean.groupBy("raw_key").agg(F.max_by("corrected", F.struct("_p", "corrected")).alias("corrected"))


def gestalt_ratio(candidate: str, name: str, cutoff: float) -> float:
    matcher = difflib.SequenceMatcher(None, candidate, name)
    if matcher.real_quick_ratio() < cutoff or matcher.quick_ratio() < cutoff:
        return 0.0
    return matcher.ratio()


def _gestalt_scores(cutoff: float) -> Callable[[Column, Column], Column]:
    @F.pandas_udf("double")
    def scores(candidates: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([gestalt_ratio(c, n, cutoff) for c, n in zip(candidates, names)], dtype="float64")

    return scores


def _edit_scores(cutoff: float) -> Callable[[Column, Column], Column]:
    """1 - edits / longer length."""
    return lambda candidate, name: F.lit(1.0) - F.levenshtein(candidate, name) / F.greatest(F.length(candidate), F.length(name), F.lit(1))


SCORERS: dict[str, tuple[Measure, Callable[[float], Callable[[Column, Column], Column]]]] = {
    "gestalt": (Measure(overlap=True), _gestalt_scores),
    "levenshtein": (Measure(), _edit_scores),
}


def suggest(names: DataFrame, catalogue: DataFrame, name: str = "normalized_species_name", scorer: str = "gestalt") -> DataFrame:
    """Up to three close catalogue names per distinct name, as ``suggestions`` pipe text.

    Close to any record (0.88) comes first, then close within the genus (0.72); ties go to the later name in
    alphabetical order, and a name that several records carry takes as many of the three places. Names meet candidates
    by shared segments (``closeness``) in three kinds of scope: all records; one genus and first word, where only the
    texts behind that word are compared; and one genus alone, for pairs whose first words are spelt differently.
    """
    measure, scores = SCORERS[scorer]
    wide, narrow = measure.check(GLOBAL_CUTOFF), measure.check(GENUS_CUTOFF)

    def kinds(text: str, third: str) -> str:
        """One row per kind of scope; the first words are unequal only where one differs from the genus as usually spelt."""
        head = f"substring_index({text}, ' ', 1)"
        row = lambda kind, scope, part, pad, cutoff: f"struct({kind} AS _kind, concat('{kind}', {scope}) AS _scope, {part} AS _text, {pad} AS _pad, {cutoff} AS _cutoff, {head} AS _head)"
        rows = [
            row(0, "''", text, 0, wide),
            row(1, f"concat(genus_key, '\\n', {head})", f"substring({text}, length({head}) + 1)", f"length({head})", narrow),
            row(2, "genus_key", text, 0, narrow),
        ]
        return f"inline(CASE WHEN {third} THEN array({', '.join(rows)}) ELSE array({', '.join(rows[:2])}) END)"

    unusual = "substring_index({0}, ' ', 1) <> concat(upper(substring(genus_key, 1, 1)), substring(genus_key, 2))".format
    records = catalogue.where("species IS NOT NULL AND genus_key IS NOT NULL").groupBy("species", "genus_key").agg(F.count(F.lit(1)).alias("copies"))
    odd = records.where(unusual("species")).selectExpr("genus_key", "true AS _odd").distinct()
    wanted = names.select(F.col(name).alias("_name")).where("_name IS NOT NULL").distinct()
    wanted = wanted.selectExpr("_name", "lower(substring_index(_name, ' ', 1)) AS genus_key").join(odd, "genus_key", "left")
    asked = wanted.selectExpr("_name", kinds("_name", f"_odd OR {unusual('_name')}"))
    offered = records.selectExpr("*", kinds("species", "true"))
    met = close_pairs(asked, offered, measure, ["_kind", "_name", "species", "genus_key", "copies"], "_kind <> 2 OR _head <> r__head")
    # The lower cutoff serves both tiers; each row is then held against its own.
    score = scores(GENUS_CUTOFF)(F.col("r_species"), F.col("_name"))
    scored = met.select("_name", F.col("r_species").alias("candidate"), "r_copies", F.expr("int(_kind > 0)").alias("tier"), score.alias("score"))
    scored = scored.where(f"score >= CASE tier WHEN 0 THEN {wide} ELSE {narrow} END")
    scored = scored.selectExpr("*", f"explode(sequence(1, int(least(r_copies, {MAX_SUGGESTIONS})))) AS _copy")
    best = top_rows(scored, ["_name", "tier"], [F.desc("score"), F.desc("candidate")], MAX_SUGGESTIONS, "_place")
    listed = best.groupBy("_name").agg(F.array_sort(F.collect_list(F.struct("tier", "_place", "candidate"))).alias("_s"))
    # Places in order; a name found in both tiers keeps its first place.
    return listed.selectExpr(f"_name AS `{name}`", f"concat_ws('|', slice(array_distinct(transform(_s, s -> s.candidate)), 1, {MAX_SUGGESTIONS})) AS suggestions")


def exact_match(names: DataFrame, catalogue: DataFrame, key: str) -> DataFrame:
    """Left join of a key column to the catalogue, last record of a key winning; adds ``record``."""
    records = by_key(catalogue).select(F.col("species_key").alias(key), F.struct(*RECORD).alias("record"))
    return names.join(records, key, "left")


def match_names(
    names: DataFrame,
    catalogue: DataFrame,
    corrections: DataFrame | None = None,
    raw: str = "raw_name",
    explicit: str | None = None,
    genus_fallback: bool = False,
    scorer: str | None = "gestalt",
) -> DataFrame:
    """The full cascade for each distinct (raw, explicit) pair; ``scorer=None`` leaves close names out."""
    inputs = [raw, *([explicit] if explicit else [])]
    cleaned = names.select(*inputs).distinct().withColumn("raw_species_name", sanitize_name(raw))
    cleaned = cleaned.withColumn("raw_key", name_key("raw_species_name", unicode=False))
    given = non_blank(canonical_name(explicit)) if explicit else F.lit(None).cast("string")
    own = canonical_name("raw_species_name", unicode=False)
    if corrections is not None:
        cleaned = cleaned.join(correction_map(corrections), "raw_key", "left")
        normalized = F.coalesce(given, F.col("corrected"), own)
    else:
        normalized = F.coalesce(given, own)
    keyed = cleaned.withColumn("_normal", normalized).withColumn("_key", F.lower("_normal"))
    matched = exact_match(keyed, catalogue, "_key")
    matched = matched.withColumn("genus_key", F.lower(F.substring_index("_normal", " ", 1)))
    matched = matched.join(genus_table(catalogue), "genus_key", "left")
    matched = cut_lineage(matched) if scorer is not None else matched
    hit = F.col("record").isNotNull()
    by_genus = ~hit & F.col("genus_names").isNotNull() & F.lit(genus_fallback)
    suggestions = F.lit("")
    if scorer is not None:
        open_names = matched.where(~hit & ~by_genus).select(F.col("_normal").alias("_open"))
        close = suggest(open_names, catalogue, "_open", scorer)
        matched = matched.join(close, F.col("_normal") == F.col("_open"), "left").drop("_open")
        suggestions = F.coalesce("suggestions", F.lit(""))
    status = (
        F.when(hit & (F.col("_key") == F.col("raw_key")), "exact_species_match")
        .when(hit, "exact_species_match_via_normalization")
        .when(by_genus, "genus_match_only")
        .when(suggestions != "", "unmatched_with_close_candidates")
        .otherwise("unmatched")
    )

    def tagged(field: str, genus_only) -> Column:
        return F.when(hit, F.col("record")[field]).when(by_genus, genus_only).otherwise("")

    return matched.select(
        *inputs,
        *(["raw_species_name"] if raw != "raw_species_name" else []),
        F.when(hit, F.col("record.species")).otherwise(F.col("_normal")).alias("normalized_species_name"),
        F.when(hit, F.col("record.genus")).otherwise(F.substring_index("_normal", " ", 1)).alias("genus"),
        F.when(hit, F.col("record.family")).otherwise(F.coalesce("genus_family", F.lit(""))).alias("family"),
        F.when(hit, F.col("record.species")).otherwise("").alias("matched_species_name"),
        tagged("protocol_group", F.lit(GENUS_ONLY_GROUP)).alias("protocol_group"),
        tagged("overlap_type", F.lit(GENUS_ONLY_OVERLAP)).alias("overlap_type"),
        tagged("protocol_usage", F.lit(GENUS_ONLY_PROTOCOLS)).alias("protocol_usage"),
        status.alias("taxonomy_match_status"),
        F.when(hit, "").when(by_genus, F.col("genus_names")).otherwise(suggestions).alias("taxonomy_suggestions"),
    )


def annotate_raw_first(names: DataFrame, catalogue: DataFrame, corrections: DataFrame, raw: str = "raw_name") -> DataFrame:
    """The second matcher: the raw name wins over the corrected one, and the first record of a key wins.

    Of repeated corrections the one with the last ``position`` counts.
    """
    records = catalogue.withColumn("_loose", name_key_loose("species", unicode=False)).where(F.col("_loose") != "")
    records = by_key(records, "_loose", keep="first")
    record = F.struct("species", "protocol_group", "overlap_type", "protocol_usage")
    position = F.col("position") if "position" in corrections.columns else F.lit(0)
    fixes = corrections.select(name_key_loose("raw_name").alias("_raw_key"), F.trim("corrected_name").alias("_fix"), position.alias("_p"))
    fixes = fixes.where((F.col("_raw_key") != "") & (F.col("_fix") != ""))
    fixes = fixes.groupBy("_raw_key").agg(F.max_by("_fix", F.struct("_p", "_fix")).alias("_fix"))
    distinct = names.select(raw).distinct().withColumn("_raw_key", name_key_loose(raw))
    fixed = distinct.join(fixes, "_raw_key", "left")
    fixed = fixed.withColumn("corrected_species_name", F.coalesce("_fix", F.col(raw)))
    fixed = fixed.withColumn("_fix_key", name_key_loose("corrected_species_name"))
    side = records.select("_loose", record.alias("_rec"))
    out = fixed.join(side.select(F.col("_loose").alias("_raw_key"), F.col("_rec").alias("_a")), "_raw_key", "left")
    out = out.join(side.select(F.col("_loose").alias("_fix_key"), F.col("_rec").alias("_b")), "_fix_key", "left")
    best = F.coalesce("_a", "_b")
    blank = F.coalesce(F.col(raw), F.lit("")) == ""
    status = (
        F.when(blank, "missing_species_folder")
        .when(F.col("_a").isNotNull(), "matched_raw")
        .when(F.col("_b").isNotNull(), "matched_corrected")
        .otherwise("not_in_catalogue")
    )
    field = lambda name: F.when(blank, "").otherwise(F.coalesce(best[name], F.lit(""))).alias
    return out.select(
        raw,
        F.when(blank, "").otherwise(F.col("corrected_species_name")).alias("corrected_species_name"),
        F.when(~blank & best.isNotNull(), 1).otherwise(0).alias("in_catalogue"),
        field("protocol_group")("protocol_group"),
        field("overlap_type")("overlap_type"),
        field("protocol_usage")("protocol_usage"),
        field("species")("matched_species_name"),
        status.alias("taxonomy_match_status"),
    )


def attach(rows: DataFrame, matches: DataFrame, on: list[str]) -> DataFrame:
    """Matches back onto the rows by the raw texts they were made from.

    The name table is computed once and cut off here: its size is then known and the rows never wait on it twice.
    """
    return rows.join(small_side(cut_lineage(matches)), on)
