"""Matching, manifests, overlap, availability and the reports around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchweave.functions import paths as P
from benchweave.operators import manifest as M
from benchweave.operators import matching, reports
from benchweave.operators.filters import in_catalogue
from benchweave.operators.ranking import dense_index
from benchweave.plans.queries_names import D_FOLDER, D_LABEL, d_canon, d_clean, d_specimen
from benchweave.plans.registry import query
from benchweave.plans.views import check, view

FIELDS = [
    "raw_species_name",
    "normalized_species_name",
    "genus",
    "family",
    "matched_species_name",
    "protocol_group",
    "overlap_type",
    "protocol_usage",
    "taxonomy_match_status",
    "taxonomy_suggestions",
]


def catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """The prepared catalogue; a small dimension read by several branches of one plan, hence kept."""
    return matching.prepare_catalogue(view(spark, sf, "catalogue")).persist()


def cascade(names: str, fallback: bool) -> dict[str, str]:
    """Check steps for the match cascade over ``names`` (raw, given) with the edit-distance scorer."""
    raw = d_clean("raw")
    return {
        "c_in": names,
        "c_fix": f"SELECT lower({d_canon('raw_name')}) AS rk, corrected_name AS fix FROM corrections",
        "c_key": f"SELECT raw, given, {raw} AS rs, lower({d_canon('raw')}) AS rk, {d_canon('raw')} AS own FROM c_in",
        "c_norm": f"SELECT k.*, coalesce(nullif({d_canon('given')}, ''), fix, own) AS nm FROM c_key k LEFT JOIN c_fix f ON f.rk = k.rk",
        "c_gen": """SELECT lower(genus) AS gk, CASE WHEN count(DISTINCT nullif(family, '')) = 1 THEN max(family) ELSE '' END AS fam,
                    array_to_string(list(species ORDER BY group_order, species)[1:3], '|') AS three FROM catalogue GROUP BY 1""",
        "c_hit": f"""SELECT n.*, c.species, c.genus AS cgenus, c.family AS cfamily, c.protocol_group, c.overlap_type, c.protocol_usage,
                    coalesce(g.fam, '') AS fam, g.three, c.species IS NULL AND g.three IS NOT NULL AND {fallback} AS by_genus
                    FROM c_norm n LEFT JOIN catalogue c ON lower(c.species) = lower(n.nm)
                    LEFT JOIN c_gen g ON g.gk = lower(split_part(n.nm, ' ', 1))""",
        "c_open": "SELECT DISTINCT nm FROM c_hit WHERE species IS NULL AND NOT by_genus",
        "c_score": """SELECT o.nm, c.species AS cand, lower(c.genus) = lower(split_part(o.nm, ' ', 1)) AS same,
                    1.0::DOUBLE - levenshtein(o.nm, c.species)::DOUBLE / greatest(length(o.nm), length(c.species)) AS score
                    FROM c_open o, catalogue c""",
        "c_tier": """SELECT nm, cand, 0 AS tier, score FROM c_score WHERE score >= 0.88
                    UNION ALL SELECT nm, cand, 1, score FROM c_score WHERE same AND score >= 0.72""",
        "c_top": """SELECT nm, cand, tier, place FROM (SELECT *, row_number() OVER (PARTITION BY nm, tier ORDER BY score DESC, cand DESC) AS place FROM c_tier) WHERE place <= 3""",
        "c_once": "SELECT nm, cand, min(tier * 10 + place) AS spot FROM c_top GROUP BY nm, cand",
        "c_sug": "SELECT nm, array_to_string(list(cand ORDER BY spot)[1:3], '|') AS sug FROM c_once GROUP BY nm",
        "c_out": """SELECT h.raw, h.given, rs AS raw_species_name, coalesce(species, h.nm) AS normalized_species_name,
                    coalesce(cgenus, split_part(h.nm, ' ', 1)) AS genus, CASE WHEN species IS NULL THEN fam ELSE cfamily END AS family,
                    coalesce(species, '') AS matched_species_name,
                    CASE WHEN species IS NOT NULL THEN protocol_group WHEN by_genus THEN 'B' ELSE '' END AS protocol_group,
                    CASE WHEN species IS NOT NULL THEN overlap_type WHEN by_genus THEN 'genus_overlap_only' ELSE '' END AS overlap_type,
                    CASE WHEN species IS NOT NULL THEN protocol_usage WHEN by_genus THEN 'P2,P3' ELSE '' END AS protocol_usage,
                    CASE WHEN species IS NOT NULL AND lower(h.nm) = rk THEN 'exact_species_match'
                         WHEN species IS NOT NULL THEN 'exact_species_match_via_normalization' WHEN by_genus THEN 'genus_match_only'
                         WHEN sug IS NOT NULL THEN 'unmatched_with_close_candidates' ELSE 'unmatched' END AS taxonomy_match_status,
                    CASE WHEN species IS NOT NULL THEN '' WHEN by_genus THEN three ELSE coalesce(sug, '') END AS taxonomy_suggestions
                    FROM c_hit h LEFT JOIN c_sug s ON s.nm = h.nm""",
    }


def _parts(spark, sf):
    return view(spark, sf, "raw_names").select("p_partkey", "raw_name")


def _per_part(fallback: bool) -> str:
    cols = ", ".join(f"o.{c}" for c in FIELDS)
    return check(
        "raw_names catalogue corrections",
        f"SELECT r.p_partkey, {cols} FROM raw_names r JOIN c_out o ON o.raw = r.raw_name",
        **cascade("SELECT DISTINCT raw_name AS raw, '' AS given FROM raw_names", fallback),
    )


@query(
    "join_catalogue",
    check(
        "raw_names catalogue",
        f"SELECT p_partkey, coalesce(c.species, '') AS species, coalesce(c.protocol_group, '') AS protocol_group FROM raw_names r LEFT JOIN catalogue c ON lower(c.species) = lower({d_canon('raw_name')})",
    ),
)
def _(spark, sf):
    from benchweave.functions.names import name_key

    names = _parts(spark, sf).select("raw_name").distinct().withColumn("_key", name_key("raw_name"))
    matched = matching.exact_match(names, catalogue(spark, sf), "_key")
    rows = matching.attach(_parts(spark, sf), matched, ["raw_name"])
    return rows.select(
        "p_partkey",
        F.coalesce("record.species", F.lit("")).alias("species"),
        F.coalesce("record.protocol_group", F.lit("")).alias("protocol_group"),
    )


@query(
    "join_corrections",
    check(
        "raw_names catalogue corrections",
        f"SELECT p_partkey, coalesce(f.corrected_name, {d_canon('r.raw_name')}) AS name FROM raw_names r LEFT JOIN corrections f ON lower({d_canon('f.raw_name')}) = lower({d_canon('r.raw_name')})",
    ),
)
def _(spark, sf):
    from benchweave.functions.names import canonical_name, name_key
    from benchweave.session import small_side

    names = _parts(spark, sf).select("raw_name").distinct().withColumn("raw_key", name_key("raw_name"))
    fixes = small_side(matching.correction_map(view(spark, sf, "corrections")))
    fixed = names.join(fixes, "raw_key", "left").select("raw_name", F.coalesce("corrected", canonical_name("raw_name")).alias("name"))
    return matching.attach(_parts(spark, sf), fixed, ["raw_name"]).select("p_partkey", "name")


@query("join_genus_fallback", _per_part(True))
def _(spark, sf):
    rows = _parts(spark, sf)
    found = matching.match_names(rows, catalogue(spark, sf), view(spark, sf, "corrections"), genus_fallback=True, scorer="levenshtein")
    return matching.attach(rows, found, ["raw_name"]).select("p_partkey", *FIELDS)


@query("join_match_cascade", _per_part(False))
def _(spark, sf):
    rows = _parts(spark, sf)
    found = matching.match_names(rows, catalogue(spark, sf), view(spark, sf, "corrections"), scorer="levenshtein")
    return matching.attach(rows, found, ["raw_name"]).select("p_partkey", *FIELDS)


@query("join_fuzzy")
def _(spark, sf):
    """Close names under the gestalt ratio, which SQL cannot express; tests compare it with brute force."""
    rows = _parts(spark, sf)
    found = matching.match_names(rows, catalogue(spark, sf), scorer="gestalt")
    return matching.attach(rows, found, ["raw_name"]).where(F.col("matched_species_name") == "").select("p_partkey", *FIELDS)


D_LOOSE = r"trim(regexp_replace(replace(lower(trim({0})), '_', ' '), '\s+', ' ', 'g'), ' .')"


@query(
    "join_raw_then_corrected",
    check(
        "raw_names catalogue corrections",
        f"""SELECT p_partkey, CASE WHEN raw_name = '' THEN '' ELSE fixed END AS corrected_species_name, cast(coalesce(a.species, b.species) IS NOT NULL AS int) AS in_catalogue,
            coalesce(a.protocol_group, b.protocol_group, '') AS protocol_group, coalesce(a.species, b.species, '') AS matched_species_name,
            CASE WHEN a.species IS NOT NULL THEN 'matched_raw' WHEN b.species IS NOT NULL THEN 'matched_corrected' ELSE 'not_in_catalogue' END AS taxonomy_match_status
            FROM f0 r LEFT JOIN catalogue a ON lower(a.species) = {D_LOOSE.format('raw_name')} LEFT JOIN catalogue b ON lower(b.species) = {D_LOOSE.format('fixed')}""",
        f0=f"""SELECT r.p_partkey, r.raw_name, coalesce(f.corrected_name, r.raw_name) AS fixed FROM raw_names r
               LEFT JOIN corrections f ON {D_LOOSE.format('f.raw_name')} = {D_LOOSE.format('r.raw_name')}""",
    ),
)
def _(spark, sf):
    rows = _parts(spark, sf)
    notes = matching.annotate_raw_first(rows, catalogue(spark, sf), view(spark, sf, "corrections"))
    return matching.attach(rows, notes, ["raw_name"]).select(
        "p_partkey", "corrected_species_name", "in_catalogue", "protocol_group", "matched_species_name", "taxonomy_match_status"
    )


ROOT = "/old/macro"


def _macro_files(spark, sf):
    files = view(spark, sf, "files").where(F.col("modality") == "macro")
    root = F.when(F.substring_index("rel_path", "/", -1).startswith("AB"), "/data/macro").otherwise("/new/macro")
    return files.select("item_id", "rel_path", P.join_path(root, "rel_path").alias("path"))


D_MACRO = """SELECT item_id, rel_path, CASE WHEN string_split(rel_path, '/')[-1] LIKE 'AB%' THEN '/data/macro/' ELSE '/new/macro/' END || rel_path AS path
             FROM files WHERE modality = 'macro'"""
D_ENTRY = f"""SELECT f.*, coalesce(a.phase, r.phase, '') AS e_phase, coalesce(a.raw_species_name, r.raw_species_name, '') AS e_raw,
              coalesce(a.corrected_species_name, r.corrected_species_name, '') AS e_fix
              FROM m_files f LEFT JOIN log a ON a.processed_path = f.path
              LEFT JOIN log r ON r.processed_path = '{ROOT}/' || f.rel_path"""


@query(
    "join_log_enrich",
    check("files log", f"SELECT item_id, e_phase, {d_clean('e_raw')} AS e_raw, {d_canon('e_fix')} AS e_fix FROM m_entry", m_files=D_MACRO, m_entry=D_ENTRY),
)
def _(spark, sf):
    rows = M.enrich_from_log(_macro_files(spark, sf), M.normalize_log(view(spark, sf, "log"), ROOT))
    blank = lambda c: F.coalesce(c, F.lit(""))
    return rows.select("item_id", blank("entry.phase").alias("e_phase"), blank("entry.raw").alias("e_raw"), blank("entry.corrected").alias("e_fix"))


MANIFEST_OUT = ", ".join(
    ["image_path", "species", "genus", "family", "specimen_id", "source_id", "phase", "raw_species_name", "protocol_group", "overlap_type", "protocol_usage"]
    + ["matched_species_name", "taxonomy_match_status", "taxonomy_suggestions"]
)


def _macro_steps() -> dict[str, str]:
    parent = "coalesce(string_split(rel_path, '/')[-2], '')"
    clean_raw = d_clean("e_raw")
    return {
        "m_files": D_MACRO,
        "m_entry": D_ENTRY,
        "m_folder": f"SELECT *, {D_FOLDER} AS folder, {parent} AS parent FROM m_entry",
        "m_raw": f"""SELECT *, coalesce(nullif({clean_raw}, ''), nullif({D_LABEL}, ''), parent) AS raw, {d_canon('e_fix')} AS given, coalesce(folder, parent) AS label_folder,
                     CASE WHEN string_split(rel_path, '/')[1] IN ('Phase1', 'Phase2') THEN string_split(rel_path, '/')[1] ELSE e_phase END AS phase FROM m_folder""",
        **cascade("SELECT DISTINCT raw, given FROM m_raw", False),
        "m_out": rf"""SELECT '/data/macro/' || rel_path AS image_path, normalized_species_name AS species, genus, family, {d_specimen('label_folder')} AS specimen_id,
                     'macro:' || regexp_replace(rel_path, '\.[^./]+$', '') AS source_id, phase, raw_species_name, protocol_group, overlap_type, protocol_usage,
                     matched_species_name, taxonomy_match_status, taxonomy_suggestions FROM m_raw m JOIN c_out o ON o.raw = m.raw AND o.given = m.given""",
    }


@query("join_macro_manifest", check("files log catalogue corrections", f"SELECT {MANIFEST_OUT} FROM m_out", **_macro_steps()))
def _(spark, sf):
    log = M.normalize_log(view(spark, sf, "log"), ROOT)
    rows = M.macro_manifest(_macro_files(spark, sf), catalogue(spark, sf), view(spark, sf, "corrections"), log, scorer="levenshtein")
    return rows.select(*MANIFEST_OUT.split(", "))


def _micro_steps() -> dict[str, str]:
    return {
        "u_files": "SELECT rel_path, string_split(rel_path, '/')[1] AS raw, '' AS given FROM files WHERE modality = 'micro'",
        **cascade("SELECT DISTINCT raw, given FROM u_files", True),
        "u_out": rf"""SELECT '/data/micro/' || rel_path AS image_path, normalized_species_name AS species, genus, family, {d_specimen('u.raw')} AS specimen_id,
                     'micro:' || regexp_replace(rel_path, '\.[^./]+$', '') AS source_id, '' AS phase, raw_species_name, protocol_group, overlap_type, protocol_usage,
                     matched_species_name, taxonomy_match_status, taxonomy_suggestions FROM u_files u JOIN c_out o ON o.raw = u.raw""",
    }


def _micro(spark, sf):
    files = view(spark, sf, "files").where(F.col("modality") == "micro")
    return M.micro_manifest(files, catalogue(spark, sf), view(spark, sf, "corrections"), scorer="levenshtein")


@query("join_micro_manifest", check("files catalogue corrections", f"SELECT {MANIFEST_OUT} FROM u_out", **_micro_steps()))
def _(spark, sf):
    return _micro(spark, sf).select(*MANIFEST_OUT.split(", "))


# Reports that mix both modalities read the items with a genus-level tag added for some micro rows.
TAGGED = """SELECT * REPLACE (CASE WHEN modality = 'micro' AND matched_species_name = '' AND genus <> 'Small' THEN 'genus_match_only' WHEN matched_species_name = '' AND phase = 'Phase1'
            THEN 'unmatched_with_close_candidates' ELSE taxonomy_match_status END AS taxonomy_match_status,
            CASE WHEN matched_species_name <> '' AND phase = 'Phase2' AND protocol_group = 'A' THEN 'Hot rod|Hot ring' ELSE '' END AS taxonomy_suggestions) FROM items"""


def tagged_items(spark, sf):
    items = view(spark, sf, "items")
    unmatched = F.col("matched_species_name") == ""
    status = (
        F.when((F.col("modality") == "micro") & unmatched & (F.col("genus") != "Small"), "genus_match_only")
        .when(unmatched & (F.col("phase") == "Phase1"), "unmatched_with_close_candidates")
        .otherwise(F.col("taxonomy_match_status"))
    )
    listed = F.when(~unmatched & (F.col("phase") == "Phase2") & (F.col("protocol_group") == "A"), "Hot rod|Hot ring").otherwise("")
    return items.withColumns({"taxonomy_match_status": status, "taxonomy_suggestions": listed})


@query(
    "flt_uncertain",
    check(
        "items",
        "SELECT item_id, taxonomy_match_status, taxonomy_suggestions FROM t WHERE taxonomy_match_status IN ('genus_match_only', 'unmatched_with_close_candidates') OR taxonomy_suggestions <> ''",
        t=TAGGED,
    ),
)
def _(spark, sf):
    from benchweave.operators.filters import is_uncertain

    return tagged_items(spark, sf).where(is_uncertain()).select("item_id", "taxonomy_match_status", "taxonomy_suggestions")


SIGNATURE = "dataset_name, modality, raw_species_name, normalized_species_name, genus, protocol_group, overlap_type, protocol_usage, taxonomy_match_status, matched_species_name, taxonomy_suggestions"


@query(
    "agg_uncertain",
    check(
        "items",
        f"SELECT {SIGNATURE}, count(*) AS image_count FROM t WHERE taxonomy_match_status IN ('genus_match_only', 'unmatched_with_close_candidates') OR taxonomy_suggestions <> '' GROUP BY {SIGNATURE}",
        t=TAGGED,
    ),
)
def _(spark, sf):
    return reports.uncertain_matches(tagged_items(spark, sf))


@query(
    "join_overlap",
    check(
        "items catalogue",
        """SELECT c.species, c.genus, c.family, c.protocol_group, c.overlap_type, c.protocol_usage, coalesce(ma, 0) AS macro_image_count, coalesce(mi, 0) AS micro_exact_image_count,
           coalesce(ns, 0) AS micro_genus_related_species_count, coalesce(ni, 0) AS micro_genus_related_image_count, coalesce(names, '') AS micro_genus_related_species,
           cast(coalesce(ma, 0) > 0 AS int) AS macro_present, cast(coalesce(mi, 0) > 0 AS int) AS micro_exact_present
           FROM catalogue c LEFT JOIN m ON m.species = c.species LEFT JOIN g ON g.genus = c.genus""",
        t=TAGGED,
        m="SELECT matched_species_name AS species, count(*) FILTER (modality = 'macro') AS ma, count(*) FILTER (modality = 'micro') AS mi FROM t WHERE matched_species_name <> '' GROUP BY 1",
        g="""SELECT genus, count(DISTINCT species) AS ns, count(*) AS ni, string_agg(DISTINCT species, '|' ORDER BY species) AS names FROM t
             WHERE modality = 'micro' AND taxonomy_match_status = 'genus_match_only' GROUP BY genus""",
    ),
)
def _(spark, sf):
    return reports.overlap_report(tagged_items(spark, sf), catalogue(spark, sf))


def _summary_sql() -> str:
    per = []
    for m in ("macro", "micro"):
        extra = "matched_species_name = ''" if m == "macro" else "protocol_usage = ''"
        figures = {
            "image_count": "count(*)",
            "species_before_normalization": "count(DISTINCT raw_species_name)",
            "species_after_normalization": "count(DISTINCT normalized_species_name)",
            "species_matched": "count(DISTINCT nullif(matched_species_name, ''))",
            "genus_only_species": "count(DISTINCT CASE WHEN taxonomy_match_status = 'genus_match_only' THEN normalized_species_name END)",
            "extra_species": f"count(DISTINCT CASE WHEN {extra} THEN normalized_species_name END)",
        }
        per += [f"SELECT '{m}' AS section, '{k}' AS item, {v} AS value FROM t WHERE modality = '{m}'" for k, v in figures.items()]
    per.append("SELECT 'catalogue', 'final_species', count(DISTINCT species) FROM catalogue")
    per.append("SELECT 'catalogue', 'species_matched', count(DISTINCT matched_species_name) FROM t WHERE matched_species_name <> ''")
    for m in ("macro", "micro"):
        per.append(f"SELECT 'catalogue', 'missing_from_{m}', count(*) FROM catalogue WHERE species NOT IN (SELECT matched_species_name FROM t WHERE modality = '{m}')")
    per.append("SELECT 'macro_groups', protocol_group, count(*) FROM t WHERE modality = 'macro' AND protocol_group <> '' GROUP BY 2")
    for p in ("P1", "P2", "P3"):
        per.append(f"SELECT 'protocols', '{p}', count(*) FROM t WHERE list_contains(string_split(protocol_usage, ','), '{p}')")
    return " UNION ALL ".join(per)


SUMMARY = _summary_sql()


def _names_sql() -> str:
    parts = []
    for m in ("macro", "micro"):
        extra = "matched_species_name = ''" if m == "macro" else "protocol_usage = ''"
        parts.append(f"SELECT DISTINCT '{m}' AS section, 'extra_species' AS kind, normalized_species_name AS name FROM t WHERE modality = '{m}' AND {extra}")
        parts.append(f"SELECT DISTINCT '{m}', 'genus_only_species', normalized_species_name FROM t WHERE modality = '{m}' AND taxonomy_match_status = 'genus_match_only'")
        parts.append(f"SELECT DISTINCT '{m}', 'missing_species', species FROM catalogue WHERE species NOT IN (SELECT matched_species_name FROM t WHERE modality = '{m}')")
    return "SELECT section, kind, row_number() OVER (PARTITION BY section, kind ORDER BY name) AS position, name FROM (" + " UNION ALL ".join(parts) + ") WHERE name IS NOT NULL"


@query("agg_taxonomy_names", check("items catalogue", _names_sql(), t=TAGGED))
def _(spark, sf):
    return reports.taxonomy_names(reports.name_profile(tagged_items(spark, sf)), catalogue(spark, sf))


@query("agg_taxonomy_summary", check("items catalogue", SUMMARY, t=TAGGED))
def _(spark, sf):
    return reports.taxonomy_summary(reports.name_profile(tagged_items(spark, sf)), catalogue(spark, sf))


@query("agg_group_counts", check("items", "SELECT protocol_group, count(*) AS image_count FROM items WHERE protocol_group <> '' GROUP BY 1"))
def _(spark, sf):
    return reports.group_counts(view(spark, sf, "items"))


@query(
    "agg_run_stats",
    check(
        "run_log",
        """SELECT 'all' AS dimension, 'files_found=' || count(*) || ' processed=' || count(*) FILTER (status = 'processed') || ' skipped=' || count(*) FILTER (status LIKE 'skipped%') ||
           ' failed=' || count(*) FILTER (status NOT LIKE 'skipped%' AND status <> 'processed') || ' in=' || sum(original_bytes) || ' out=' || coalesce(sum(new_bytes), 0) AS item, count(*) AS n FROM run_log
           UNION ALL SELECT 'phase', phase, count(*) FROM run_log GROUP BY 2 UNION ALL SELECT 'in_catalogue', cast(in_catalogue AS varchar), count(*) FROM run_log GROUP BY 2
           UNION ALL SELECT 'protocol_group', coalesce(nullif(protocol_group, ''), 'unmatched'), count(*) FROM run_log GROUP BY 2""",
    ),
)
def _(spark, sf):
    log = view(spark, sf, "run_log")
    s = reports.run_stats(log)
    names = {"files_found": "files_found", "processed": "processed", "skipped": "skipped", "failed": "failed", "in": "total_original_bytes", "out": "total_output_bytes"}
    text = F.concat_ws(" ", *[F.concat(F.lit(k + "="), F.col(c).cast("string")) for k, c in names.items()])
    head = s.select(F.lit("all").alias("dimension"), text.alias("item"), F.col("files_found").alias("n"))
    return head.unionByName(reports.run_breakdown(log))


@query(
    "join_availability",
    check("required available", "SELECT r.doc_id, label, cast(a.doc_id IS NOT NULL AS int) AS present, a.bytes AS found_bytes FROM required r LEFT JOIN available a ON a.doc_id = r.doc_id"),
)
def _(spark, sf):
    return reports.check_availability(view(spark, sf, "required"), view(spark, sf, "available"), "doc_id")


@query(
    "agg_availability",
    check(
        "required available",
        """SELECT count(*) AS required, count(a.doc_id) AS present, count(*) - count(a.doc_id) AS missing, round(count(a.doc_id) * 100.0 / count(*), 6) AS present_pct,
           coalesce(sum(a.bytes), 0) AS present_bytes, count(DISTINCT label) AS entities_checked, count(DISTINCT CASE WHEN a.doc_id IS NULL THEN label END) AS entities_missing
           FROM required r LEFT JOIN available a ON a.doc_id = r.doc_id""",
    ),
)
def _(spark, sf):
    checked = reports.check_availability(view(spark, sf, "required"), view(spark, sf, "available"), "doc_id")
    return reports.availability_summary(checked, "label").withColumn("present_pct", F.round("present_pct", 6))


@query("lim_missing_sample", check("required available", "SELECT doc_id, label FROM required r WHERE NOT EXISTS (SELECT 1 FROM available a WHERE a.doc_id = r.doc_id) ORDER BY doc_id LIMIT 20"))
def _(spark, sf):
    return reports.missing_sample(view(spark, sf, "required"), view(spark, sf, "available"), "doc_id", 20)


@query(
    "flt_in_catalogue",
    check(
        "files catalogue corrections",
        f"SELECT item_id, matched FROM f2 WHERE matched IS NOT NULL",
        f0=f"SELECT item_id, rel_path, {D_FOLDER} AS folder FROM files WHERE modality = 'macro'",
        f1=f"SELECT item_id, {D_LABEL} AS label FROM f0",
        f2=f"""SELECT item_id, coalesce(a.species, f.corrected_name) AS matched FROM f1 LEFT JOIN catalogue a ON lower(a.species) = {D_LOOSE.format('label')}
               LEFT JOIN corrections f ON {D_LOOSE.format('f.raw_name')} = {D_LOOSE.format('label')}""",
    ),
)
def _(spark, sf):
    files = view(spark, sf, "files").where(F.col("modality") == "macro").select("item_id", P.entity_label(P.entity_folder("rel_path")).alias("raw_name"))
    notes = matching.annotate_raw_first(files, catalogue(spark, sf), view(spark, sf, "corrections"))
    return in_catalogue(matching.attach(files, notes, ["raw_name"])).select("item_id", F.col("matched_species_name").alias("matched"))


@query(
    "win_collision_names",
    check(
        "files",
        r"""SELECT rel_path, CASE WHEN dup > 1 THEN regexp_replace(name, '\.jpg$', '') || '__dup' || dup || '.jpg' ELSE name END AS output_path FROM c3""",
        c0=r"""SELECT phase || '/' || string_split(item_id, '-')[1] || CASE WHEN length(item_id) % 2 = 0 THEN '.PNG' WHEN length(item_id) % 3 = 0 THEN '.png' ELSE '.tif' END || '' AS rel_path FROM files""",
        c1=r"SELECT DISTINCT rel_path, regexp_replace(rel_path, '\.[^./]+$', '') AS base, lower(regexp_extract(rel_path, '\.([^./]+)$', 1)) AS ext FROM c0",
        c2="SELECT *, CASE WHEN count(*) OVER (PARTITION BY base) > 1 THEN base || '__from_' || ext || '.jpg' ELSE base || '.jpg' END AS name FROM c1",
        c3="SELECT rel_path, name, row_number() OVER (PARTITION BY name ORDER BY rel_path) AS dup FROM c2",
    ),
)
def _(spark, sf):
    size = F.length("item_id")
    ext = F.when(size % 2 == 0, ".PNG").when(size % 3 == 0, ".png").otherwise(".tif")
    files = view(spark, sf, "files").select(F.concat("phase", F.lit("/"), F.substring_index("item_id", "-", 1), ext).alias("rel_path")).distinct()
    return M.output_names(files)


@query(
    "join_label_index",
    check("items", "SELECT i.item_id, l.label FROM items i JOIN l USING (species)", l="SELECT species, row_number() OVER (ORDER BY species) - 1 AS label FROM (SELECT DISTINCT species FROM items)"),
)
def _(spark, sf):
    items = view(spark, sf, "items").select("item_id", "species")
    labels = reports.label_index(items)
    return reports.attach_labels(items, labels).select("item_id", "label")


@query(
    "join_dense_fill",
    check(
        "items",
        "SELECT s.species, k.phase, coalesce(n, 0) AS n FROM (SELECT DISTINCT species FROM items) s CROSS JOIN (SELECT unnest(['Phase1', 'Phase2', 'Phase3']) AS phase) k LEFT JOIN c ON c.species = s.species AND c.phase = k.phase",
        c="SELECT species, phase, count(*) AS n FROM items WHERE modality = 'macro' GROUP BY ALL",
    ),
)
def _(spark, sf):
    items = view(spark, sf, "items").select("species", "modality", "phase")
    counts = items.where(F.col("modality") == "macro").groupBy("species", "phase").agg(F.count(F.lit(1)).alias("n"))
    phases = spark.createDataFrame([("Phase1",), ("Phase2",), ("Phase3",)], "phase string")
    return reports.dense_fill(counts, items.select("species").distinct(), phases, ["n"])


@query(
    "agg_dataset_summary",
    check(
        "items",
        """SELECT 'samples' AS item, count(*) AS value FROM items UNION ALL SELECT 'species', count(DISTINCT species) FROM items
           UNION ALL SELECT 'modality=' || modality, count(*) FROM items GROUP BY 1 UNION ALL SELECT 'protocol_group=' || protocol_group, count(*) FROM items WHERE protocol_group <> '' GROUP BY 1""",
    ),
)
def _(spark, sf):
    return reports.dataset_summary(view(spark, sf, "items"))


@query(
    "agg_index_lists",
    check(
        "items",
        "SELECT species, modality, row_index // 8192 AS chunk, count(*) AS n, md5(string_agg(cast(row_index AS varchar), ',' ORDER BY row_index)) AS digest FROM r GROUP BY ALL",
        r="SELECT species, modality, row_number() OVER (ORDER BY item_id) - 1 AS row_index FROM items",
    ),
)
def _(spark, sf):
    indexed = dense_index(view(spark, sf, "items").select("item_id", "species", "modality"), ["item_id"])
    lists = reports.index_lists(indexed, ["species", "modality"])
    text = F.concat_ws(",", F.transform("indices", lambda x: x.cast("string")))
    return lists.select("species", "modality", "chunk", F.size("indices").cast("bigint").alias("n"), F.md5(text).alias("digest"))


@query(
    "agg_pairing_stats",
    check(
        "items",
        """SELECT count(*) FILTER (modality = 'macro') AS macro_samples, count(*) FILTER (modality = 'micro') AS micro_samples,
           count(DISTINCT CASE WHEN modality = 'macro' THEN species END) AS macro_species, count(DISTINCT CASE WHEN modality = 'micro' THEN species END) AS micro_species,
           (SELECT count(*) FROM (SELECT species FROM t GROUP BY 1 HAVING count(DISTINCT modality) = 2)) AS paired_species,
           (SELECT count(*) FROM (SELECT genus FROM t GROUP BY 1 HAVING count(DISTINCT modality) = 2)) AS shared_genera FROM t""",
        t="SELECT * FROM items WHERE NOT (modality = 'macro' AND protocol_group = 'C') AND NOT (modality = 'micro' AND genus = 'Hot')",
    ),
)
def _(spark, sf):
    items = view(spark, sf, "items")
    kept = items.where(~((F.col("modality") == "macro") & (F.col("protocol_group") == "C")) & ~((F.col("modality") == "micro") & (F.col("genus") == "Hot")))
    return reports.pairing_stats(kept)


@query("srt_manifest", check("items", "SELECT item_id, dataset_name, modality, phase, protocol_group, species, image_path FROM items"))
def _(spark, sf):
    cols = ["item_id", "dataset_name", "modality", "phase", "protocol_group", "species", "image_path"]
    return M.sort_manifest(view(spark, sf, "items").select(*cols))


@query("srt_split", check("items", "SELECT species, modality, phase, image_path FROM items"))
def _(spark, sf):
    return M.sort_split(view(spark, sf, "items").select("species", "modality", "phase", "image_path"))


@query(
    "srt_catalogue",
    check("catalogue", "SELECT species, protocol_group, cast(group_order AS int) AS group_order, CASE protocol_group WHEN 'A' THEN 0 WHEN 'B' THEN 1 WHEN 'C' THEN 2 ELSE 999 END AS rank FROM catalogue"),
)
def _(spark, sf):
    ordered = matching.sort_catalogue(catalogue(spark, sf))
    return ordered.select("species", "protocol_group", "group_order", matching.group_rank("protocol_group").alias("rank"))


@query("set_union_sources", check("files", "SELECT item_id, 'Phase' || cast(1 + (phase = 'Phase2')::int AS varchar) AS phase FROM files WHERE modality = 'macro' AND phase <> ''"))
def _(spark, sf):
    files = view(spark, sf, "files").where(F.col("modality") == "macro")
    roots = {p: files.where(F.col("phase") == p).select("item_id") for p in ("Phase1", "Phase2")}
    return M.union_sources(roots)


@query("set_union_matched", check("items", "SELECT DISTINCT matched_species_name AS species FROM items WHERE matched_species_name <> ''"))
def _(spark, sf):
    return reports.matched_names(view(spark, sf, "items"))


@query("set_intersect_genera", check("items", "SELECT genus FROM items WHERE modality = 'macro' AND protocol_group <> 'A' INTERSECT SELECT genus FROM items WHERE modality = 'micro' AND protocol_group = 'A'"))
def _(spark, sf):
    items = view(spark, sf, "items")
    return reports.shared_genera(items.where((F.col("modality") == "macro") != (F.col("protocol_group") == "A")))


@query(
    "set_except_missing",
    check("items catalogue", "SELECT species FROM catalogue EXCEPT SELECT matched_species_name FROM items WHERE modality = 'micro' AND phase = 'Phase1' AND protocol_group <> 'B'"),
)
def _(spark, sf):
    items = view(spark, sf, "items").where((F.col("phase") == "Phase1") & (F.col("protocol_group") != "B"))
    return reports.missing_names(catalogue(spark, sf), items, "micro")
