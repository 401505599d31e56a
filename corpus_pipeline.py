"""A training-text pipeline of five stages, each one operator of ``benchweave.llm``.

``STAGES`` holds (name, function) pairs; a function takes (spark, docs, sf_dir) and returns the rows that the next stage
reads, after they were written as Parquet. All but the last return the columns of documents. Intermediate tables of one
stage are removed when the next begins in the same thread; no other tables are. Empty input passes through every stage. Rows with a null id are kept by every
filter unless their text is a copy of, or is nearly equal to, another one.
"""

from __future__ import annotations

import functools
import threading
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchweave.llm import exact_dedup, ngram_jaccard, packing, quality, substring_dedup
from benchweave.llm.staging import collecting, discard, stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_QUALITY = 0.3
_last = threading.local()


def pipeline_stage(step: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``step``, beginning with the removal of what this thread's stage before it has staged and no longer needs."""

    @functools.wraps(step)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for table in getattr(_last, "tables", []):
            if table.sparkSession.sparkContext.applicationId == spark.sparkContext.applicationId:
                discard(table)
        _last.tables = []
        with collecting(_last.tables):
            return step(spark, docs, sf_dir)

    return run_stage


@pipeline_stage
def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it learns from the labels of four folds in five."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet").select("doc_id", "quality")
    learned = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    weights = quality.train(quality.draw_labelled(docs, learned))
    return quality.score(docs, weights, output="__score").where(F.col("__score") >= LEAST_QUALITY).select(*COLUMNS)


@pipeline_stage
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text after blank normalisation, the one with the smallest id stays."""
    return exact_dedup.drop_exact_copies(docs).select(*COLUMNS)


@pipeline_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id (null before all): five-word
    shingles, similarity 0.8 or more.

    Rows are told apart by their whole content, so that null and repeated ids never mix two documents; rows repeated in
    full stay once.
    """
    keyed = docs.select(*COLUMNS, F.struct("doc_id", F.xxhash64(*COLUMNS).alias("content")).alias("__key"))
    groups = ngram_jaccard.jaccard_components(keyed, key="__key", n=5, num=80, den=100)
    later = groups.where("__key <> component_id").select("__key.content").distinct()
    kept = keyed.withColumn("content", F.col("__key.content")).join(later, "content", "left_anti")
    if not groups.groupBy("__key").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["content"])
    return kept.select(*COLUMNS)


@pipeline_stage
def shared_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages that occur elsewhere go; every document stays, with what is left of its text."""
    done = substring_dedup.remove_repeats(docs)
    return done.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("kept_text").cast("long")).select(*COLUMNS)


@pipeline_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_filter", quality_filter),
    ("exact_copies", exact_copies),
    ("near_duplicates", near_duplicates),
    ("shared_passages", shared_passages),
    ("pack_sequences", pack_sequences),
]

#: The classifier, the tokenizer and the packing cannot be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    before = None
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name, held=True)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
