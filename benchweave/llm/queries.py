"""The thin queries of the contract: each applies its operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchweave.llm import (
    bpe,
    embedding_dedup,
    exact_dedup,
    hard_negatives,
    language_id,
    license_scan,
    ngram_jaccard,
    packing,
    quality,
    sentence_pieces,
    substring_dedup,
    url_filters,
    whitening,
)
from benchweave.llm.staging import stage

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


@query("op1_substring_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op3_ngram_jaccard")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_components(table(spark, sf_dir, "documents", "doc_id", "text"), n=3, num=90, den=100)


@query(
    "op7_exact_dedup",
    r"""
    WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS s FROM documents)
    SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
           doc_id = min(doc_id) OVER (PARTITION BY s) AS kept, s AS text_sha256
    FROM d
    """,
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op8_embedding_near_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


@query("op10_url_filters")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filters.judge(table(spark, sf_dir, "pages", "page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "p_block")


@query("op2_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents", "doc_id", "text"), BYTE_BPE, keep=False)


@query("op9_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"), WORD_BPE)


def fold(parts: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang").withColumn("held_out", F.coalesce(fold(3) == 1, F.lit(False)))
    dictionaries = language_id.learn(docs.where("not held_out"))
    return language_id.classify(docs.select("doc_id", "held_out", "text"), dictionaries).drop("text")


@query("op6_quality")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").where(fold(5) != 0)
    weights = quality.train(quality.draw_labelled(docs, labels))
    scored = quality.score(docs.withColumn("held_out", F.coalesce(fold(5) == 0, F.lit(False))), weights)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op4_license_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of the tree source / language / block of ids; those of mostly licence text are its licence files."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.floor(F.col("doc_id") / 1000).cast("string"), F.col("doc_id").cast("string"))
    scanned = license_scan.scan(docs.select("doc_id", path.alias("path"), "text"), keep_text=False)
    files = stage(scanned, "licence-files")
    return license_scan.inherit(files).select("doc_id", "path", "own_licence", "score", "licence_lines", "licence_share", "licence", "licence_from")


@query("op11_sentence_pieces")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode_decode(table(spark, sf_dir, "documents", "doc_id", "text"), PIECE_BPE, keep=False)


@query(
    "op12_hard_negatives",
    """
    WITH p AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda c: coalesce(isfinite(c), false))) = len(embedding)
    ), s AS (
        SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score
        FROM p a JOIN p b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
    ), pos AS (
        SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5
    ), neg AS (
        SELECT pos.a, pos.b AS positive, pos.score AS positive_score, s.b AS negative, s.score AS negative_score,
               row_number() OVER (PARTITION BY pos.a, pos.b ORDER BY s.score DESC, s.b) AS rank
        FROM pos JOIN s ON s.a = pos.a AND NOT s.same AND 50 * pos.score <= 100 * s.score AND 100 * s.score <= 95 * pos.score
    )
    SELECT a AS anchor_id, positive AS positive_id, rank, negative AS negative_id, positive_score, negative_score FROM neg WHERE rank <= 3
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(hard_negatives.quantised(vectors, F.col("vec_id") % 50 == 0, label))


@query("op13_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings", "vec_id", "embedding")).withColumn("deviation", F.col("deviation").cast("long"))
