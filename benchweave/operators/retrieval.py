"""Cosine top-k across two sets, the hits they score, and resampled confidence intervals."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchweave.functions.hashing import hash_uniform
from benchweave.functions.names import genus_of, non_blank
from benchweave.operators.blocks import block_join
from benchweave.operators.ranking import top_rows
from benchweave.session import cut_lineage, small_side

# Similarities are compared after rounding, so that equal vectors tie whatever block they were in.
TIE_DECIMALS = 9
# Query rows whose products with a block of the gallery are held at a time.
KERNEL_ROWS = 256
# Seed steps of the confidence-interval tasks.
R5_SEED_STEP = 10_003
TASK_SEED_STEP = 100_000


def unit_matrix(column: pd.Series) -> np.ndarray:
    matrix = np.stack(column.to_numpy()).astype(np.float64)
    lengths = np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
    return matrix / lengths


def _side(df: DataFrame, prefix: str, *keys: str) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(f"{prefix}_{c}") for c in ("id", "species", "genus", "embedding")])


def with_query_rows(queries: DataFrame) -> DataFrame:
    """Queries with a number per row, ``q_row``, so that queries that share an id stay apart.

    The numbers are kept on shared storage: a task that runs again must not number its rows anew.
    """
    if "q_row" in queries.columns:
        return queries
    return cut_lineage(queries.select("id", "species", "genus", "embedding", F.monotonically_increasing_id().alias("q_row")))


def top_k(queries: DataFrame, gallery: DataFrame, k: int = 5, exclude_self: bool = True, block_rows: int = 2048) -> DataFrame:
    """The ``k`` most similar gallery rows per query row (``q_row``), exact; ties go to the smaller id.

    Frames carry id, species, genus, embedding. Every block pair multiplies two bounded matrices and returns at most
    ``k`` rows per query; the final rank keeps ``k`` per query before and after the shuffle.
    """

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["q_row", "q_id", "q_species", "q_genus", "g_id", "g_species", "g_genus", "similarity"]
        if not len(left) or not len(right):
            return pd.DataFrame(columns=columns)
        right = right.sort_values(["g_id", "g_species", "g_genus"], kind="stable", ignore_index=True)
        candidates = unit_matrix(right["g_embedding"]).T
        pieces = [left.iloc[at : at + KERNEL_ROWS] for at in range(0, len(left), KERNEL_ROWS)]
        return pd.concat([best(piece, right, candidates, columns) for piece in pieces], ignore_index=True)

    def best(left: pd.DataFrame, right: pd.DataFrame, candidates: np.ndarray, columns: list[str]) -> pd.DataFrame:
        sims = unit_matrix(left["q_embedding"]) @ candidates
        np.round(sims, TIE_DECIMALS, out=sims)
        if exclude_self:
            sims[left["q_id"].to_numpy()[:, None] == right["g_id"].to_numpy()[None, :]] = -np.inf
        take = min(k, sims.shape[1])
        limit = np.partition(sims, sims.shape[1] - take, axis=1)[:, sims.shape[1] - take]
        rows, cols = np.nonzero((sims >= limit[:, None]) & np.isfinite(sims))
        order = np.lexsort((cols, -sims[rows, cols], rows))
        rows, cols = rows[order], cols[order]
        start = np.searchsorted(rows, rows)
        keep = np.arange(len(rows)) - start < take
        rows, cols = rows[keep], cols[keep]
        parts = [left[c].to_numpy()[rows] for c in columns[:4]] + [right[c].to_numpy()[cols] for c in columns[4:7]]
        return pd.DataFrame(dict(zip(columns, [*parts, sims[rows, cols]])))

    schema = "q_row bigint, q_id string, q_species string, q_genus string, g_id string, g_species string, g_genus string, similarity double"
    left = _side(with_query_rows(queries), "q", "q_row")
    partial = block_join(left, _side(gallery, "g"), kernel, schema, "q_row", "g_id", left_rows=block_rows, right_rows=block_rows * 2)
    return top_rows(partial, ["q_row"], [F.desc("similarity"), F.col("g_id"), F.col("g_species"), F.col("g_genus")], k, "rank")


def eligible(queries: DataFrame, gallery: DataFrame, exclude_self: bool = True) -> DataFrame:
    """Per query whether its species and its genus occur in the gallery (not counting itself).

    Gallery labels are counted first; queries join the counts, never the gallery rows. ``q_row`` is kept if there is one.
    """
    keys = [c for c in ("q_row",) if c in queries.columns]
    by_species = gallery.groupBy("species").agg(F.count(F.lit(1)).alias("_ns"))
    by_genus = gallery.groupBy("genus").agg(F.count(F.lit(1)).alias("_ng"))
    out = queries.select(*keys, "id", "species", "genus").join(by_species, "species", "left").join(by_genus, "genus", "left")
    own_s, own_g = F.lit(0), F.lit(0)
    if exclude_self:
        twins_s = gallery.groupBy("id", "species").agg(F.count(F.lit(1)).alias("_ts"))
        twins_g = gallery.groupBy("id", "genus").agg(F.count(F.lit(1)).alias("_tg"))
        out = out.join(twins_s, ["id", "species"], "left").join(twins_g, ["id", "genus"], "left")
        own_s, own_g = F.coalesce("_ts", F.lit(0)), F.coalesce("_tg", F.lit(0))
    return out.select(
        *keys,
        "id",
        "species",
        "genus",
        (F.coalesce("_ns", F.lit(0)) > own_s).cast("int").alias("eligible_exact"),
        (F.coalesce("_ng", F.lit(0)) > own_g).cast("int").alias("eligible_genus"),
    )


def score_queries(queries: DataFrame, gallery: DataFrame, k: int = 5, exclude_self: bool = True) -> DataFrame:
    """One row per query: eligibility, hit@1, hit@k and purity@k on species and genus level."""
    queries = with_query_rows(queries)
    ranked = top_k(queries, gallery, k, exclude_self)
    same = {"exact": F.col("q_species") == F.col("g_species"), "genus": F.col("q_genus") == F.col("g_genus")}
    aggs = []
    for level, match in same.items():
        hit = match.cast("int")
        aggs += [
            F.max(F.when(F.col("rank") == 1, hit)).alias(f"{level}_r1"),
            F.max(hit).alias(f"{level}_rk"),
            F.avg(hit.cast("double")).alias(f"{level}_purity"),
        ]
    scored = ranked.groupBy("q_row").agg(*aggs)
    zero = [c for level in same for c in (f"{level}_r1", f"{level}_rk", f"{level}_purity")]
    return eligible(queries, gallery, exclude_self).join(scored, "q_row", "left").na.fill(0, zero).drop("q_row")


def direction_report(scored: DataFrame, gallery: DataFrame, label: str) -> DataFrame:
    """Recall and purity of one direction over its eligible queries; NULL when none is eligible."""
    aggs = [F.count(F.lit(1)).alias("query_count")]
    for level in ("exact", "genus"):
        ok = F.col(f"eligible_{level}") == 1
        aggs.append(F.coalesce(F.sum(f"eligible_{level}"), F.lit(0)).cast("bigint").alias(f"eligible_{level}_queries"))
        for source, name in (("r1", "recall_at_1"), ("rk", "recall_at_5"), ("r1", "top1_purity"), ("purity", "top5_purity")):
            aggs.append(F.avg(F.when(ok, F.col(f"{level}_{source}").cast("double"))).alias(f"{level}_{name}"))
    return scored.agg(*aggs).withColumn("direction", F.lit(label)).withColumn("gallery_count", F.lit(gallery.count()))


def split_modalities(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    return embeddings.where(F.col("modality") == "macro"), embeddings.where(F.col("modality") == "micro")


def retrieval_report(embeddings: DataFrame, k: int = 5) -> DataFrame:
    """Both directions, without self exclusion (the report's convention)."""
    macro, micro = split_modalities(embeddings)
    forward = direction_report(score_queries(macro, micro, k, False), micro, "macro_to_micro")
    backward = direction_report(score_queries(micro, macro, k, False), macro, "micro_to_macro")
    return forward.unionByName(backward)


def recall_by_entity(scored: DataFrame, level: str = "exact") -> DataFrame:
    """Mean hit@1 per query label over eligible queries, weakest first; labels never found are flagged."""
    label = "species" if level == "exact" else "genus"
    rows = scored.where(F.col(f"eligible_{level}") == 1)
    out = rows.groupBy(label).agg(F.count(F.lit(1)).alias("queries"), F.avg(F.col(f"{level}_r1").cast("double")).alias("recall_at_1"))
    return out.withColumn("never_found", (F.col("recall_at_1") == 0).cast("int")).orderBy("recall_at_1", label)


def require_eligible(scored: DataFrame, level: str = "exact") -> None:
    if scored.where(F.col(f"eligible_{level}") == 1).isEmpty():
        raise ValueError(f"no query has a matching {level} label in the gallery")


def bootstrap_values(hits: DataFrame, keys: Sequence[str], resamples: int, seed=42) -> DataFrame:
    """Resampled mean hit per (keys, resample).

    ``hits`` holds one row per eligible query: keys, id, hit (0/1). Every query makes one draw per resample; a draw
    lands on a hit when its index falls among the hits, so no resample looks up other rows and the draws reduce to
    one row per resample before the shuffle. ``seed`` may be a column name.
    """
    keys = list(keys)
    # One row per task; counted before it is broadcast, because the few tasks are far too coarse as shuffle keys.
    totals = small_side(hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum("hit").alias("_h")))
    base = hits.select(*keys, "id", *([seed] if isinstance(seed, str) and seed not in keys else []))
    joined = base.join(totals, keys)
    draws = joined.withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    source = F.col(seed) if isinstance(seed, str) else seed
    lands = F.floor(hash_uniform(source, "resample", "id") * F.col("_n")) < F.col("_h")
    return draws.groupBy(*keys, "resample").agg((F.sum(lands.cast("bigint")) / F.max("_n")).alias("value"))


def bootstrap_ci(hits: DataFrame, keys: Sequence[str], resamples: int = 1000, seed=42, confidence: float = 0.95) -> DataFrame:
    """Point estimate, resampled mean, deviation and percentile interval per key."""
    keys = list(keys)
    alpha = (1.0 - confidence) / 2.0
    # Totals, draws and point estimates all read the hits: score the queries once, keep one small row per query.
    hits = cut_lineage(hits)
    values = bootstrap_values(hits, keys, resamples, seed)
    spread = values.groupBy(*keys).agg(
        F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.percentile("value", F.lit(alpha)).alias("ci_lower"),
        F.percentile("value", F.lit(1.0 - alpha)).alias("ci_upper"),
    )
    point = hits.groupBy(*keys).agg(F.avg(F.col("hit").cast("double")).alias("point_estimate"), F.count(F.lit(1)).alias("queries"))
    return point.join(spread, keys).withColumn("ci_width", F.col("ci_upper") - F.col("ci_lower"))


def hit_rows(scored: DataFrame, direction: str, level: str, seed: int, drop_rk: bool = False) -> DataFrame:
    """Long (task, seed, id, hit) rows of one direction and level, for the bootstrap."""
    cuts = [("R1", f"{level}_r1", seed)] + ([] if drop_rk else [("R5", f"{level}_rk", seed + R5_SEED_STEP)])
    picks = F.array(*[F.struct(F.lit(f"{direction}_{level}_{n}").alias("task"), F.lit(s).alias("seed"), F.col(c).cast("int").alias("hit")) for n, c, s in cuts])
    rows = scored.where(F.col(f"eligible_{level}") == 1).select("id", F.explode(picks).alias("x"))
    return rows.select("x.task", "x.seed", "id", "x.hit")


def bootstrap_suite(embeddings: DataFrame, resamples: int = 1000, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """All tasks of one dataset in one job: two directions, species R1/R5 and genus R1, each with its own seed."""
    macro, micro = split_modalities(embeddings)
    # Species and genus tasks both read the scores: each direction is searched once.
    forward, backward = cut_lineage(score_queries(macro, micro)), cut_lineage(score_queries(micro, macro))
    tasks = [(forward, "M2m", "exact"), (backward, "m2M", "exact"), (forward, "M2m", "genus"), (backward, "m2M", "genus")]
    rows = None
    for i, (scored, direction, level) in enumerate(tasks):
        part = hit_rows(scored, direction, level, seed + i * TASK_SEED_STEP, drop_rk=level == "genus")
        rows = part if rows is None else rows.unionByName(part)
    return bootstrap_ci(rows, ["task", "seed"], resamples, "seed", confidence)


def validate_vectors(embeddings: DataFrame, vector: str = "embedding", keys: Sequence[str] = ("modality",)) -> DataFrame:
    """Per key: rows, missing vectors, rows whose length differs from the most of the key, smallest and largest length."""
    size = F.size(vector)
    present = F.col(vector).isNotNull()
    return embeddings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~present).alias("missing"),
        F.min(F.when(present, size)).cast("bigint").alias("min_dim"),
        F.max(F.when(present, size)).cast("bigint").alias("max_dim"),
        F.count_if(present & F.exists(vector, lambda x: x.isNull() | F.isnan(x))).alias("bad_values"),
    )


def require_vectors(embeddings: DataFrame, vector: str = "embedding") -> None:
    """Raise unless both modalities have rows and all vectors share one length."""
    report = {r["modality"]: r for r in validate_vectors(embeddings, vector).collect()}
    for modality in ("macro", "micro"):
        if modality not in report:
            raise ValueError(f"no {modality} embeddings")
        if report[modality]["missing"]:
            raise ValueError(f"{report[modality]['missing']} {modality} rows lack {vector}")
    dims = {r[d] for m, r in report.items() if m in ("macro", "micro") for d in ("min_dim", "max_dim")}
    if len(dims) != 1:
        raise ValueError(f"embedding lengths differ: {sorted(dims)}")


def with_genus(embeddings: DataFrame) -> DataFrame:
    """Genus from the species name where it is blank."""
    have = "genus" in embeddings.columns
    derived = genus_of("species")
    return embeddings.withColumn("genus", F.coalesce(non_blank("genus"), derived) if have else derived)


