"""Streaming accumulators and caller-supplied functions."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from benchweave.functions.vectors import softmax_top
from benchweave.operators import custom
from benchweave.plans.dialect import SparkDialect
from benchweave.plans.queries_metrics import D_LOSS, D_PRED, D_STEPS, LOSSES
from benchweave.plans.registry import query
from benchweave.plans.views import check, view
from benchweave.session import ensure_checkpoint_dir
from benchweave.streaming import accumulators as S


def _stream(spark, sf, table):
    # The bracket makes it a pattern, so that a table may be one file or a folder of files.
    schema = spark.read.parquet(f"{sf}/{table}.parquet").schema
    return S.read_stream(spark, f"{sf}/{table}.parque[t]", schema)


@query("str_confusion", check("scores", "SELECT true_label, pred_label, count(*) AS n FROM pred GROUP BY ALL", pred=D_PRED))
def _(spark, sf):
    top, _ = softmax_top("scores")
    rows = _stream(spark, sf, "embeddings").select(F.col("label").cast("bigint").alias("true_label"), F.expr(SparkDialect(sf).fold("embedding", 10)).alias("scores"))
    return S.drain(S.running_confusion(rows.withColumn("pred_label", top)))


@query("str_weighted_losses", check("", D_LOSS, s=D_STEPS.format("lineitem")))
def _(spark, sf):
    lines = _stream(spark, sf, "lineitem")
    steps = lines.select(
        F.col("l_returnflag").alias("stage"),
        (F.col("l_extendedprice") / 10000).alias("total_loss"),
        F.col("l_discount").alias("macro_loss"),
        F.col("l_tax").alias("micro_loss"),
        (F.col("l_quantity") / 50).alias("contrast_loss"),
        (F.col("l_discount") * 2).alias("genus_loss"),
        F.col("l_linenumber").alias("macro_samples"),
        (F.col("l_quantity").cast("int") % 4).alias("micro_samples"),
        (F.col("l_suppkey") % 3).cast("int").alias("anchors"),
        (F.col("l_partkey") % 2).cast("int").alias("genus_pairs"),
    )
    return S.drain(S.running_losses(steps)).withColumns({c: F.round(c, 5) for c in LOSSES})


@query(
    "str_history",
    "SELECT user_id AS run, arg_min(event_id, event_id) FILTER (value = m) AS best_epoch, max(value) AS best_metric, count(*) AS epochs FROM (SELECT *, max(value) OVER (PARTITION BY user_id) AS m FROM events) GROUP BY user_id",
)
def _(spark, sf):
    events = _stream(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("epoch"), F.col("value").alias("metric"))
    return S.drain(S.best_epochs(events))


@query(
    "str_history_json",
    """SELECT user_id AS run, arg_min(event_id, event_id) FILTER (value = m) AS best_epoch, max(value) AS best_metric, count(*) AS epochs
       FROM (SELECT cast(user_id AS varchar) AS user_id, event_id, value, max(value) OVER (PARTITION BY user_id) AS m FROM events) GROUP BY user_id""",
)
def _(spark, sf):
    """All events as an appended JSON-lines history, tailed as a stream."""
    root = f"{ensure_checkpoint_dir(spark)}/histories/{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf}/events.parquet")
    records = events.select(
        F.col("user_id").cast("string").alias("run"),
        F.col("event_id").alias("epoch"),
        F.col("event_type").alias("stage_name"),
        F.create_map(F.lit("score"), F.col("value").cast("double")).alias("val_metrics"),
    )
    records.write.json(root)
    return S.drain(S.best_epochs(S.metric_rows(S.history_stream(spark, root), "score")))


def _double(batch: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"id": batch["id"], "modality": batch["modality"], "total": [round(float(np.sum(v, dtype=np.float64)) * 2, 4) for v in batch["embedding"]]})


def _largest(batch: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"id": batch["id"], "modality": batch["modality"], "total": [round(float(np.max(v)), 4) for v in batch["embedding"]]})


@query(
    "udf_transform_map",
    check("emb", "SELECT id, modality, CASE WHEN modality = 'macro' THEN round(list_sum(embedding::DOUBLE[]) * 2, 4) ELSE round(list_max(embedding)::DOUBLE, 4) END AS total FROM emb"),
)
def _(spark, sf):
    rows = view(spark, sf, "emb").select("id", "modality", "embedding")
    return custom.map_items(rows, {"macro": _double, "micro": _largest}, "id string, modality string, total double")


def _make_scorer():
    def predict(vectors: np.ndarray) -> np.ndarray:
        return vectors * np.float32(4.0)

    return predict


@query(
    "udf_batch_score",
    check("", "SELECT vec_id, cast(list_position(s, list_max(s)) - 1 AS bigint) AS pred_label, round(1.0 / list_sum(list_transform(s, lambda x: exp((x - list_max(s)) * 4))), 4) AS confidence FROM f0", f0="SELECT vec_id, embedding::DOUBLE[] AS s FROM embeddings"),
)
def _(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    scored = custom.score(rows, _make_scorer, "embedding", 64)
    return scored.select("vec_id", "pred_label", F.round("confidence", 4).alias("confidence"))


def _make_encoder():
    def encode(vectors: np.ndarray) -> np.ndarray:
        return vectors[:, :32] - vectors[:, 32:64]

    return encode


@query(
    "udf_batch_embed",
    check(
        "",
        "SELECT vec_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 4) AS first, round(v[32] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 4) AS last FROM f0",
        f0="SELECT vec_id, list_transform(range(1, 33), lambda i: embedding[i]::DOUBLE - embedding[i + 32]::DOUBLE) AS v FROM embeddings",
    ),
)
def _(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    encoded = custom.embed(rows, _make_encoder, "embedding", 64)
    return encoded.select("vec_id", F.round(F.element_at("embedding", 1).cast("double"), 4).alias("first"), F.round(F.element_at("embedding", 32).cast("double"), 4).alias("last"))
