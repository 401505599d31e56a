"""Scalar functions and filters over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from benchweave.functions import names as N
from benchweave.functions import paths as P
from benchweave.functions import text as X
from benchweave.functions import vectors as V
from benchweave.functions.hashing import hash_uniform, stable_hash
from benchweave.operators import filters, manifest
from benchweave.plans.dialect import h16, unit
from benchweave.plans.registry import query
from benchweave.plans.views import check, view


def d_clean(x: str) -> str:
    return rf"trim(trim(regexp_replace(replace({x}, '_', ' '), '\s+', ' ', 'g')), ' .')"


def d_canon(x: str) -> str:
    return f"(upper(left({d_clean(x)}, 1)) || lower(substr({d_clean(x)}, 2)))"


def d_round(x: str, n: int = 6) -> str:
    return f"round({x}, {n})"


@query("fn_sanitize_name", check("raw_names", f"SELECT p_partkey, {d_clean('raw_name')} AS clean FROM raw_names"))
def _(spark, sf):
    return view(spark, sf, "raw_names").select("p_partkey", N.sanitize_name("raw_name").alias("clean"))


@query("fn_sanitize_meta", r"SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest FROM documents")
def _(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select("doc_id", F.sha2(N.sanitize_meta("text"), 256).alias("digest"))


@query("fn_canonical_name", check("raw_names", f"SELECT p_partkey, {d_canon('raw_name')} AS name FROM raw_names"))
def _(spark, sf):
    return view(spark, sf, "raw_names").select("p_partkey", N.canonical_name("raw_name").alias("name"))


@query("fn_name_key", check("raw_names", f"SELECT p_partkey, lower({d_canon('raw_name')}) AS name_key FROM raw_names"))
def _(spark, sf):
    return view(spark, sf, "raw_names").select("p_partkey", N.name_key("raw_name").alias("name_key"))


@query(
    "fn_name_key_loose",
    check("raw_names", r"SELECT p_partkey, trim(regexp_replace(replace(lower(trim(raw_name)), '_', ' '), '\s+', ' ', 'g'), ' .') AS name_key FROM raw_names"),
)
def _(spark, sf):
    return view(spark, sf, "raw_names").select("p_partkey", N.name_key_loose("raw_name").alias("name_key"))


@query("fn_genus", check("raw_names", f"SELECT p_partkey, split_part({d_canon('raw_name')}, ' ', 1) AS genus FROM raw_names"))
def _(spark, sf):
    return view(spark, sf, "raw_names").select("p_partkey", N.genus_of("raw_name").alias("genus"))


@query(
    "fn_tokens",
    check(
        "items",
        """SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(
             string_split(protocol_usage || ', P3 ,,P9', ','), lambda x: trim(x)), lambda x: x <> ''))), '|') AS tokens FROM items""",
    ),
)
def _(spark, sf):
    items = view(spark, sf, "items").select("item_id", F.concat("protocol_usage", F.lit(", P3 ,,P9")).alias("usage"))
    return items.select("item_id", F.concat_ws("|", F.array_sort(N.tokens("usage"))).alias("tokens"))


@query(
    "fn_pipe_list",
    """SELECT p_partkey, cast(len(l) AS bigint) AS n, array_to_string(l, '|') AS text FROM (SELECT p_partkey,
       list_filter(list_transform(string_split(p_brand || '| |' || p_type || '||' || p_brand, '|'), lambda x: trim(x)), lambda x: x <> '') AS l FROM part)""",
)
def _(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    parts = part.select("p_partkey", N.pipe_list(F.concat("p_brand", F.lit("| |"), "p_type", F.lit("||"), "p_brand")).alias("l"))
    return parts.select("p_partkey", F.size("l").cast("bigint").alias("n"), N.pipe_text("l").alias("text"))


D_FOLDER = r"list_filter(string_split(rel_path, '/')[1:-2], lambda x: regexp_matches(x, '^\s*\d+\s*\.\s*(.+?)\s*$'))[1]"
D_LABEL = d_clean(r"regexp_extract(coalesce(folder, ''), '^\s*\d+\s*\.\s*(.+?)\s*$', 1)")


@query(
    "fn_folder_name",
    check("files", f"SELECT item_id, coalesce(folder, '') AS folder, {D_LABEL} AS label FROM f0", f0=f"SELECT item_id, {D_FOLDER} AS folder FROM files"),
)
def _(spark, sf):
    files = view(spark, sf, "files").select("item_id", P.entity_folder("rel_path").alias("folder"))
    return files.select("item_id", F.coalesce("folder", F.lit("")).alias("folder"), P.entity_label(F.col("folder")).alias("label"))


@query(
    "fn_phase",
    check("files", "SELECT item_id, CASE WHEN string_split(rel_path, '/')[1] IN ('Phase1', 'Phase2') THEN string_split(rel_path, '/')[1] ELSE 'none' END AS phase FROM files"),
)
def _(spark, sf):
    return view(spark, sf, "files").select("item_id", P.phase_of("rel_path", F.lit("none")).alias("phase"))


D_STEM = r"regexp_replace(string_split(rel_path, '/')[-1], '\.[^.]+$', '')"


def d_specimen(folder: str) -> str:
    dirs = "string_split(rel_path, '/')[1:-2]"
    below = f"array_to_string({dirs}[list_position({dirs}, {folder}) + 1:], '/')"
    code = rf"regexp_extract({D_STEM}, '^([A-Za-z]{{1,8}}\d{{2,}}[A-Za-z0-9-]*)[_-].*$', 1)"
    return f"coalesce(CASE WHEN list_position({dirs}, {folder}) > 0 THEN nullif({below}, '') END, nullif({code}, ''), {D_STEM})"


@query(
    "fn_specimen",
    check("files", f"SELECT item_id, {d_specimen('folder')} AS specimen FROM f0", f0=f"SELECT item_id, rel_path, {D_FOLDER} AS folder FROM files"),
)
def _(spark, sf):
    files = view(spark, sf, "files").withColumn("folder", P.entity_folder("rel_path"))
    return files.select("item_id", P.specimen_of("rel_path", "folder").alias("specimen"))


@query("fn_source_id", check("files", r"SELECT item_id, 'bench:' || regexp_replace(rel_path, '\.[^./]+$', '') AS source_id FROM files"))
def _(spark, sf):
    return view(spark, sf, "files").select("item_id", P.source_id("bench", "rel_path").alias("source_id"))


@query("fn_resolve_path", check("items", "SELECT item_id, CASE WHEN modality = 'macro' THEN '/mnt/m/' || image_rel_path ELSE image_path END AS path FROM items"))
def _(spark, sf):
    return view(spark, sf, "items").select("item_id", P.resolve_path("image_path", "image_rel_path", "modality", {"macro": "/mnt/m/"}).alias("path"))


@query("fn_stable_hash", f"SELECT o_orderkey, {h16(42, 'o_orderkey', 'o_orderpriority')} AS h, {unit(42, 'o_orderkey')} AS u FROM orders")
def _(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return orders.select("o_orderkey", stable_hash(42, "o_orderkey", "o_orderpriority").alias("h"), hash_uniform(42, "o_orderkey").alias("u"))


@query(
    "fn_optional_id",
    check("items", "SELECT item_id, CASE WHEN lower(trim(t)) IN ('', 'na', 'n/a', 'none', 'null', 'nan', 'missing', 'unknown') THEN '' ELSE trim(t) END AS token FROM f0", f0="SELECT item_id, ' ' || specimen_id || ' ' AS t FROM items"),
)
def _(spark, sf):
    return view(spark, sf, "items").select("item_id", N.optional_id(F.concat(F.lit(" "), "specimen_id", F.lit(" "))).alias("token"))


D_GROUP_KEY = "concat_ws('|', dataset_name, modality, species, CASE WHEN specimen_id <> 'NA' THEN 'specimen:' || specimen_id ELSE 'source:' || source_id END)"


@query("fn_group_key", check("items", f"SELECT item_id, {D_GROUP_KEY} AS group_key FROM items"))
def _(spark, sf):
    return view(spark, sf, "items").select("item_id", P.group_key().alias("group_key"))


def _edge(side: str) -> str:
    scaled = f"greatest(1, cast(round_even({side} * (1280.0 / greatest(width, height)::DOUBLE), 0) AS bigint))"
    return f"CASE WHEN greatest(width, height) = 1280 THEN {side} ELSE {scaled} END"


@query("fn_fit_long_side", check("dims", f"SELECT p_partkey, {_edge('width')} AS new_width, {_edge('height')} AS new_height FROM dims"))
def _(spark, sf):
    w, h = X.fit_long_side("width", "height", 1280)
    return view(spark, sf, "dims").select("p_partkey", w.alias("new_width"), h.alias("new_height"))


@query(
    "fn_format_bytes",
    """SELECT doc_id, CASE WHEN b < 1024 THEN printf('%.2f B', b) WHEN b < 1048576 THEN printf('%.2f KB', b / 1024)
       WHEN b < 1073741824 THEN printf('%.2f MB', b / 1048576) WHEN b < 1099511627776 THEN printf('%.2f GB', b / 1073741824)
       ELSE printf('%.2f TB', b / 1099511627776) END AS size_text
       FROM (SELECT doc_id, cast(n_chars * power(100, doc_id % 6) AS double) AS b FROM documents)""",
)
def _(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    size = (F.col("n_chars") * F.pow(F.lit(100.0), F.col("doc_id") % 6)).cast("double")
    return docs.select("doc_id", X.format_bytes(size).alias("size_text"))


@query(
    "fn_try_float",
    """SELECT p_partkey, TRY_CAST(trim(t) AS double) AS number FROM (SELECT p_partkey,
       CASE p_partkey % 4 WHEN 0 THEN ' ' || cast(p_size AS varchar) || '.5 ' WHEN 1 THEN '' WHEN 2 THEN p_brand ELSE cast(p_size AS varchar) || 'e2' END AS t FROM part)""",
)
def _(spark, sf):
    size = F.col("p_size").cast("string")
    text = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit(" "), size, F.lit(".5 "))).when(F.col("p_partkey") % 4 == 1, "")
    text = text.when(F.col("p_partkey") % 4 == 2, F.col("p_brand")).otherwise(F.concat(size, F.lit("e2")))
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", X.try_float(text).alias("number"))


@query(
    "fn_pct_text",
    check(
        "conf",
        """SELECT event_id, printf('%.1f', round(confidence * 100, 4)) AS pct, CASE WHEN correct = 1 THEN printf('%.4f', round(confidence, 6)) ELSE 'n/a' END AS metric,
           '(' || printf('%.1f', round(confidence * 50, 4)) || '--' || printf('%.1f', round(confidence * 100, 4)) || ')' AS ci FROM f0""",
        f0="SELECT event_id, correct, floor(confidence * 128) / 128 AS confidence FROM conf",
    ),
)
def _(spark, sf):
    conf = view(spark, sf, "conf").withColumn("confidence", F.floor(F.col("confidence") * 128) / 128)
    return conf.select(
        "event_id",
        X.percent_text("confidence").alias("pct"),
        X.metric_text(F.when(F.col("correct") == 1, F.col("confidence"))).alias("metric"),
        X.interval_text(F.col("confidence") / 2, "confidence").alias("ci"),
    )


@query(
    "fn_softmax_top",
    check(
        "scores",
        "SELECT vec_id, cast(list_position(s, list_max(s)) - 1 AS bigint) AS pred_label, round(1.0 / list_sum(list_transform(s, lambda x: exp(x - list_max(s)))), 6) AS confidence FROM f0",
        f0="SELECT vec_id, scores::DOUBLE[] AS s FROM scores",
    ),
)
def _(spark, sf):
    top, conf = V.softmax_top("scores")
    return view(spark, sf, "scores").select("vec_id", top.alias("pred_label"), F.round(conf, 6).alias("confidence"))


D_NORM = "greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-12)"


@query(
    "fn_l2_normalize",
    check(
        "",
        f"SELECT vec_id, round(v[1] / {D_NORM}, 6) AS first, round(v[-1] / {D_NORM}, 6) AS last, round(list_sum(list_transform(v, lambda x: abs(x))) / {D_NORM}, 5) AS l1 FROM f0",
        f0="SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings",
    ),
)
def _(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", V.l2_normalize("embedding").alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + F.abs(x))
    return vectors.select("vec_id", F.round(F.element_at("v", 1), 6).alias("first"), F.round(F.element_at("v", -1), 6).alias("last"), F.round(total, 5).alias("l1"))


@query(
    "fn_cosine",
    check(
        "",
        "SELECT vec_id, round(list_cosine_similarity(v, list_reverse(v)), 6) AS cosine, round(1 - list_cosine_similarity(v, list_reverse(v)), 6) AS distance FROM f0",
        f0="SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings",
    ),
)
def _(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("other", F.reverse("embedding"))
    return vectors.select(
        "vec_id", F.round(V.cosine("embedding", "other"), 6).alias("cosine"), F.round(V.cosine_distance("embedding", "other"), 6).alias("distance")
    )


@query(
    "fn_feature_source",
    """SELECT vec_id, cast(len(embedding) AS bigint) AS dim, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings""",
)
def _(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").withColumnRenamed("embedding", "projected_feature")
    picked = rows.select("vec_id", V.feature_vector("projected").alias("v"))
    total = F.aggregate(V.as_doubles("v"), F.lit(0.0), lambda acc, x: acc + x)
    return picked.select("vec_id", F.size("v").cast("bigint").alias("dim"), F.round(total, 5).alias("total"))


@query(
    "fn_manifest_row",
    check(
        "items",
        """SELECT image_path, image_rel_path, dataset_name, modality, view, species, genus, family, specimen_id, source_id, phase, raw_species_name,
           normalized_species_name, protocol_group, overlap_type, protocol_usage, matched_species_name, taxonomy_match_status, taxonomy_suggestions FROM items""",
    ),
)
def _(spark, sf):
    return manifest.project_manifest(view(spark, sf, "items"))


ITEM = "item_id, modality, species, protocol_usage"


@query("flt_modality", check("items", f"SELECT {ITEM} FROM items WHERE modality = 'micro'"))
def _(spark, sf):
    return filters.filter_modality(view(spark, sf, "items"), "micro").select(*ITEM.split(", "))


@query("flt_protocol", check("items", f"SELECT {ITEM} FROM items WHERE list_has_any(string_split(protocol_usage, ','), ['P1', 'P2'])"))
def _(spark, sf):
    return filters.filter_protocol(view(spark, sf, "items"), ["p1", " P2 "]).select(*ITEM.split(", "))


@query("flt_candidates", check("items", f"SELECT {ITEM} FROM items WHERE list_contains(string_split(protocol_usage, ','), 'P1')"))
def _(spark, sf):
    return manifest.sort_manifest(filters.candidates(view(spark, sf, "items"), "P1")).select(*ITEM.split(", "))


@query("flt_known_status", check("run_log", "SELECT page_id, CASE WHEN status = 'processed' THEN 'processed' WHEN status LIKE 'skipped%' THEN 'skipped' ELSE 'failed' END AS kind FROM run_log"))
def _(spark, sf):
    return view(spark, sf, "run_log").select("page_id", filters.status_class().alias("kind"))


@query(
    "flt_valid_rows",
    check(
        "items",
        """SELECT row_index, row_index + 2 AS line, CASE WHEN species = '' THEN 'missing species' ELSE 'missing path' END AS reason FROM f1
           WHERE species = '' OR (image_path = '' AND image_rel_path = '')""",
        f1="""SELECT row_number() OVER (ORDER BY item_id) - 1 AS row_index, CASE WHEN protocol_group = '' AND phase = '' THEN '' ELSE species END AS species,
              CASE WHEN specimen_id = 'NA' THEN '' ELSE image_path END AS image_path, CASE WHEN phase = 'Phase1' THEN '' ELSE image_rel_path END AS image_rel_path FROM items""",
    ),
)
def _(spark, sf):
    from benchweave.operators.ranking import dense_index

    items = view(spark, sf, "items")
    broken = items.select(
        "item_id",
        F.when((F.col("protocol_group") == "") & (F.col("phase") == ""), "").otherwise(F.col("species")).alias("species"),
        F.when(F.col("specimen_id") == "NA", "").otherwise(F.col("image_path")).alias("image_path"),
        F.when(F.col("phase") == "Phase1", "").otherwise(F.col("image_rel_path")).alias("image_rel_path"),
    )
    return filters.rejects(dense_index(broken, ["item_id"])).select("row_index", "line", "reason")
