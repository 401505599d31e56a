"""Readers and writers checked by what comes back: each query writes tables to the shared folder and reads them again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from benchweave.operators import manifest as M
from benchweave.operators import matching, splits
from benchweave.plans.queries_curation import ROOT, SUMMARY, TAGGED, catalogue, tagged_items
from benchweave.plans.queries_names import d_canon, d_clean
from benchweave.plans.queries_splits import CLASS_COUNTS, ROWS, rows
from benchweave.plans.registry import query
from benchweave.plans.views import check, view
from benchweave.schemas import MANIFEST_COLUMNS
from benchweave.session import ensure_checkpoint_dir
from benchweave.sources import embeddings, files, sinks, tables


def scratch(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/io/{uuid.uuid4().hex}"


@query(
    "src_files",
    """SELECT DISTINCT '_tree/lang=' || coalesce(lang, 'none') || '/source=' || coalesce(source, 'none') AS folder, true AS has_bytes FROM documents
       UNION ALL SELECT '_tree', false""",
)
def _(spark, sf):
    """Folders of a tree written from the documents, below a hidden folder, and the empty marker file at its top."""
    path = scratch(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", *[F.coalesce(c, F.lit("none")).alias(c) for c in ("lang", "source")])
    docs.hint("rebalance", "lang", "source").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").partitionBy("lang", "source").parquet(f"{path}/_tree")
    found = files.scan_files(spark, path, ["", ".parquet"]).select("rel_path", "bytes")
    return found.select(F.regexp_replace("rel_path", "/[^/]*$", "").alias("folder"), (F.col("bytes") > 0).alias("has_bytes")).distinct()


MANIFEST_LIST = ", ".join(MANIFEST_COLUMNS)


@query("src_csv", check("items", f"SELECT {MANIFEST_LIST} FROM items"))
def _(spark, sf):
    path = scratch(spark)
    sinks.write_csv(view(spark, sf, "items"), path, MANIFEST_COLUMNS, packed=True)
    return tables.read_table(spark, path, MANIFEST_COLUMNS)


@query("src_required_cols", "SELECT p_partkey, p_name FROM part")
def _(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    return tables.require_columns(part, ["p_partkey", "p_name"]).select("p_partkey", "p_name")


DEFAULT_ROWS = ", ".join(f"('{k.lower()}', '{v}')" for k, v in tables.DEFAULT_CORRECTIONS.items())


@query(
    "src_alias_cols",
    check("raw_names", f"SELECT raw_key, corrected FROM (VALUES {DEFAULT_ROWS}) v(raw_key, corrected) UNION SELECT lower({d_canon('raw_name')}), {d_canon('p_name')} FROM raw_names WHERE raw_name <> p_name"),
)
def _(spark, sf):
    path = scratch(spark)
    pairs = view(spark, sf, "raw_names").where(F.col("raw_name") != F.col("p_name")).select(F.col("raw_name").alias("typo"), F.col("p_name").alias("canonical")).distinct()
    sinks.write_csv(pairs, path, ["typo", "canonical"])
    return matching.correction_map(tables.load_corrections(spark, path))


@query(
    "src_log",
    check(
        "log",
        f"SELECT processed_path AS abs_key, CASE WHEN processed_path LIKE '{ROOT}/%' THEN substr(processed_path, {len(ROOT) + 2}) ELSE '' END AS rel_key, phase, {d_clean('raw_species_name')} AS raw, {d_canon('corrected_species_name')} AS corrected FROM log",
    ),
)
def _(spark, sf):
    path = scratch(spark)
    columns = ["processed_path", "phase", "raw_species_folder_name", "raw_species_name", "corrected_species_name"]
    sinks.write_csv(view(spark, sf, "log"), path, columns)
    log = M.normalize_log(tables.read_log(spark, path), ROOT)
    return log.select("abs_key", F.coalesce("rel_key", F.lit("")).alias("rel_key"), "entry.phase", "entry.raw", "entry.corrected")


D_SUM = "round(list_sum(embedding::DOUBLE[]), 5)"


def _total():
    return F.round(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda acc, x: acc + x), 5).alias("total")


@query("src_embed_records", check("emb", f"SELECT id AS image_path, modality, species, genus, {D_SUM} AS total FROM emb"))
def _(spark, sf):
    path = scratch(spark)
    emb = view(spark, sf, "emb").select(F.col("id").alias("image_path"), "modality", "species", "genus", "embedding")
    emb.write.json(path)
    return embeddings.read_records(spark, path, lines=True).select("image_path", "modality", "species", "genus", _total())


@query("src_embed_list", check("emb", f"SELECT modality || ':' || cast(row_number() OVER (PARTITION BY modality ORDER BY vec_id) - 1 AS VARCHAR) AS id, modality, species, genus, {D_SUM} AS total FROM emb"))
def _(spark, sf):
    """One JSON list of records without paths, read in pieces."""
    path = scratch(spark)
    emb = view(spark, sf, "emb").withColumn("record", F.to_json(F.struct("modality", "species", "genus", "embedding")))
    least = emb.agg(F.min("vec_id")).first()[0]
    listed = emb.select("vec_id", F.concat(F.when(F.col("vec_id") == least, "[").otherwise(","), "record").alias("value"))
    end = spark.createDataFrame([(2**62, "]")], listed.schema)
    listed.unionByName(end).orderBy("vec_id").select("value").coalesce(1).write.text(path)
    return embeddings.read_records(spark, path).select("id", "modality", "species", "genus", _total())


@query("src_csv_split", "SELECT doc_id::VARCHAR AS doc_id, md5(coalesce(text, '')) AS text_md5, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents")
def _(spark, sf):
    """Whole texts with their line breaks in CSV files, one a range of ids, read in pieces."""
    path = scratch(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.col("doc_id").alias("o"))
    ordered = docs.orderBy("o").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ordered.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return tables.read_split_table(spark, path, ["doc_id", "text"]).select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "position")


@query("src_embed_cache", check("emb", f"SELECT id, modality, {D_SUM} AS total FROM emb"))
def _(spark, sf):
    path = scratch(spark)
    embeddings.cached(spark, path, lambda: view(spark, sf, "emb"))
    return embeddings.cached(spark, path, lambda: view(spark, sf, "emb").limit(0)).select("id", "modality", _total())


@query("snk_csv", "SELECT cast(doc_id AS varchar) AS doc_id, lang, sha256(text) AS digest, '' AS note FROM documents")
def _(spark, sf):
    path = scratch(spark)
    columns = ["doc_id", "text", "lang", "note"]
    sinks.write_csv(spark.read.parquet(f"{sf}/documents.parquet"), path, columns)
    back = tables.read_table(spark, path, columns, multiline=True)
    return back.select("doc_id", "lang", F.sha2("text", 256).alias("digest"), "note")


@query(
    "snk_json",
    check("items", """SELECT '{"image_count":' || count(*) || ',"protocol_group":"' || protocol_group || '"}' AS value FROM items WHERE protocol_group <> '' GROUP BY protocol_group"""),
)
def _(spark, sf):
    from benchweave.operators import reports

    path = scratch(spark)
    sinks.write_json(reports.group_counts(view(spark, sf, "items")), path)
    return spark.read.text(path)


@query("snk_jsonl_append", "SELECT user_id AS run, event_id AS epoch, value AS metric FROM events")
def _(spark, sf):
    path = scratch(spark)
    records = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("run"), F.col("event_id").alias("epoch"), F.col("value").alias("metric"))
    for part in (0, 1):
        sinks.append_records(records.where(F.col("epoch") % 2 == part), path)
    return spark.read.schema("run bigint, epoch bigint, metric double").json(path)


@query(
    "snk_bundle",
    check(
        "items",
        """SELECT 'modality=' || modality AS part, image_path FROM items
           UNION ALL SELECT 'protocol=' || p, image_path FROM items, (VALUES ('P1'), ('P2'), ('P3')) v(p) WHERE list_contains(string_split(protocol_usage, ','), p)""",
    ),
)
def _(spark, sf):
    paths = sinks.write_bundle(view(spark, sf, "items"), catalogue(spark, sf), scratch(spark))
    by_modality = tables.read_table(spark, paths["by_modality"]).select(F.concat(F.lit("modality="), "part").alias("part"), "image_path")
    by_protocol = tables.read_table(spark, paths["by_protocol"]).select(F.concat(F.lit("protocol="), "protocol").alias("part"), "image_path")
    return by_modality.unionByName(by_protocol)


@query("snk_split_files", check("items", "SELECT 'P3' AS protocol, split, item_id FROM rows", **ROWS))
def _(spark, sf):
    paths = sinks.write_splits(rows(spark, sf), "P3", scratch(spark), splits.split_summary, lambda written: splits.class_counts(written, "P3"))
    return tables.read_table(spark, paths["splits"]).select("protocol", "split", "item_id")


@query("snk_split_counts", CLASS_COUNTS)
def _(spark, sf):
    """The class counts written next to the split files."""
    paths = sinks.write_splits(rows(spark, sf), "P3", scratch(spark), splits.split_summary, lambda written: splits.class_counts(written, "P3"))
    back = tables.read_table(spark, f"{paths['class_counts']}/protocol=P3")
    text = ("protocol", "split", "species", "protocol_group")
    return back.select(*[F.col(c) if c in text else F.col(c).cast("bigint").alias(c) for c in back.columns])


@query(
    "snk_bundle_reports",
    check(
        "items catalogue",
        f"""SELECT 'overlap' AS part, c.species AS name, count(t.image_path) AS n FROM catalogue c LEFT JOIN t ON t.matched_species_name = c.species GROUP BY c.species
            UNION ALL SELECT 'uncertain', raw_species_name, count(*) FROM t
            WHERE taxonomy_match_status IN ('genus_match_only', 'unmatched_with_close_candidates') OR taxonomy_suggestions <> '' GROUP BY raw_species_name
            UNION ALL SELECT 'summary', section || '.' || item, value FROM ({SUMMARY})""",
        t=TAGGED,
    ),
)
def _(spark, sf):
    """The overlap, uncertain and nested summary reports of a bundle, read back."""
    tagged = tagged_items(spark, sf)
    paths = sinks.write_bundle(tagged, catalogue(spark, sf), scratch(spark))
    whole = lambda name: F.col(name).cast("bigint")
    overlap = tables.read_table(spark, paths["overlap"]).select(F.lit("overlap").alias("part"), F.col("species").alias("name"), (whole("macro_image_count") + whole("micro_exact_image_count")).alias("n"))
    uncertain = tables.read_table(spark, paths["uncertain"]).groupBy("raw_species_name").agg(F.sum(whole("image_count")).alias("n"))
    summary = spark.read.schema("section string, figures map<string, bigint>").json(paths["summary"]).select("section", F.explode("figures").alias("item", "n"))
    named = summary.select(F.lit("summary"), F.concat_ws(".", "section", "item"), "n")
    return overlap.union(uncertain.select(F.lit("uncertain"), "raw_species_name", "n")).union(named)
