"""Cross-modality pairs inside batches: relations, counts, policies, control assignments and pair losses.

A batch is a bounded unit by construction. Counts are products of label counts and list no pairs; losses meet items in
bounded blocks and return one partial row per anchor and block, so even an oversized batch is cut into equal pieces.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from benchweave.functions.hashing import stable_hash
from benchweave.functions.vectors import cosine_distance
from benchweave.operators.blocks import block_join
from benchweave.operators.retrieval import unit_matrix

# Names of the relation policies and default loss settings.
POLICIES = (
    "exact_only",
    "exact_plus_genus_soft",
    "exact_plus_genus_relaxed_negative",
    "genus_only",
    "shuffled_exact_control",
    "hard_negative_control",
)
TEMPERATURE = 0.07
SIMILARITY_FLOOR = 0.35
EPSILON = 1e-8


def relation(species_a, species_b, genus_a, genus_b) -> Column:
    return F.when(species_a == species_b, "exact").when(genus_a == genus_b, "genus_soft").otherwise("unrelated")


def pair_relations(batches: DataFrame) -> DataFrame:
    """Each macro item with each micro item of its batch and how they relate (the table itself is the result)."""
    cols = ["id", "species", "genus"]
    macro = batches.where(F.col("modality") == "macro").select("batch_id", *[F.col(c).alias(f"a_{c}") for c in cols])
    micro = batches.where(F.col("modality") == "micro").select("batch_id", *[F.col(c).alias(f"b_{c}") for c in cols])
    pairs = macro.join(micro, "batch_id")
    how = relation(F.col("a_species"), F.col("b_species"), F.col("a_genus"), F.col("b_genus"))
    return pairs.select("batch_id", F.col("a_id").alias("macro_id"), F.col("b_id").alias("micro_id"), how.alias("relation"))


def exact_pairs(batches: DataFrame) -> DataFrame:
    """The exact pairs alone: an equi-join on batch and species, which lists no other pair."""
    side = lambda modality, name: batches.where(F.col("modality") == modality).select("batch_id", "species", F.col("id").alias(name))
    both = side("macro", "macro_id").join(side("micro", "micro_id"), ["batch_id", "species"])
    return both.select("batch_id", "macro_id", "micro_id", F.lit("exact").alias("relation"))


def _label_counts(batches: DataFrame, label: Column) -> DataFrame:
    keyed = batches.withColumn("_label", label)
    return keyed.groupBy("batch_id", "genus", "_label").agg(
        F.count_if(F.col("modality") == "macro").alias("a"), F.count_if(F.col("modality") == "micro").alias("b")
    )


def pair_counts(batches: DataFrame) -> DataFrame:
    """Per batch: exact and genus pairs and the anchors that have one, from label counts alone."""
    per = _label_counts(batches, F.col("species"))
    lists = per.groupBy("batch_id", "genus").agg(F.sum("a").alias("A"), F.sum("b").alias("B"), F.collect_list(F.struct("a", "b")).alias("s"))
    zero = F.lit(0).cast("bigint")
    fold = lambda f: F.aggregate("s", zero, lambda acc, x: acc + f(x))
    exact = fold(lambda x: x["a"] * x["b"])
    both = lambda x: F.when((x["a"] > 0) & (x["b"] > 0), x["a"] + x["b"]).otherwise(zero)
    soft = lambda x: F.when(F.col("B") > x["b"], x["a"]).otherwise(zero) + F.when(F.col("A") > x["a"], x["b"]).otherwise(zero)
    per_genus = lists.select(
        "batch_id",
        exact.alias("e"),
        (F.col("A") * F.col("B") - exact).alias("g"),
        fold(both).alias("ea"),
        fold(soft).alias("ga"),
    )
    return per_genus.groupBy("batch_id").agg(
        F.sum("e").alias("exact_pairs"), F.sum("g").alias("genus_pairs"), F.sum("ea").alias("exact_anchors"), F.sum("ga").alias("genus_anchors")
    )


def control_labels(batches: DataFrame, category: str = "species", seed: int = 42) -> DataFrame:
    """``assigned`` species for every item: micro items swap labels so that none keeps its own category.

    Micro items of a batch are lined up by (category, hash) and read the label m places on, m being the largest
    category; possible exactly when 2m <= n and n > 1, else micro items get NULL. Macro items keep their species.
    """
    micro = batches.where(F.col("modality") == "micro").withColumn("_h", stable_hash(seed, "batch_id", "id"))
    sizes = micro.groupBy("batch_id", category).agg(F.count(F.lit(1)).alias("c")).groupBy("batch_id").agg(F.max("c").alias("_m"), F.sum("c").alias("_n"))
    line = Window.partitionBy("batch_id").orderBy(category, "_h", "id")
    placed = micro.withColumn("_pos", F.row_number().over(line) - 1).join(sizes, "batch_id")
    source = placed.select("batch_id", F.col("_pos").alias("_from"), F.col("species").alias("assigned"))
    wanted = placed.withColumn("_from", F.when((F.col("_n") > 1) & (2 * F.col("_m") <= F.col("_n")), (F.col("_pos") + F.col("_m")) % F.col("_n")).cast("int"))
    moved = wanted.join(source, ["batch_id", "_from"], "left").select(*batches.columns, "assigned")
    macro = batches.where(F.col("modality") != "micro").withColumn("assigned", F.col("species"))
    return macro.unionByName(moved)


def policy_labels(batches: DataFrame, policy: str, seed: int = 42) -> DataFrame:
    """Adds the label that decides positives under a policy."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}; expected one of {POLICIES}")
    if policy == "shuffled_exact_control":
        return control_labels(batches, "species", seed)
    if policy == "hard_negative_control":
        return control_labels(batches, "genus", seed)
    return batches.withColumn("assigned", F.col("species"))


def is_positive(policy: str, how: Column) -> Column:
    """Whether a cross-modality pair counts as positive, for the policies that go by relation."""
    return how == ("genus_soft" if policy == "genus_only" else "exact")


def negative_weight(policy: str, how: Column, genus_weight: float = 0.5) -> Column:
    """Weight of a pair in the denominator: same-genus pairs are eased, or exact pairs left out."""
    if not 0.0 <= genus_weight <= 1.0:
        raise ValueError("genus_weight must be in [0, 1]")
    if policy == "exact_plus_genus_relaxed_negative":
        return F.when(how == "genus_soft", float(genus_weight)).otherwise(1.0)
    if policy == "genus_only":
        return F.when(how == "exact", 0.0).otherwise(1.0)
    return F.lit(1.0)


def active_pairs(batches: DataFrame, policy: str, seed: int = 42) -> DataFrame:
    """Per batch: positive pairs and anchors under a policy, from label counts."""
    if policy == "genus_only":
        counts = pair_counts(batches)
        return counts.select("batch_id", F.col("genus_pairs").alias("pairs"), F.col("genus_anchors").alias("anchors"))
    if policy not in ("shuffled_exact_control", "hard_negative_control"):
        counts = pair_counts(batches)
        return counts.select("batch_id", F.col("exact_pairs").alias("pairs"), F.col("exact_anchors").alias("anchors"))
    labelled = policy_labels(batches, policy, seed)
    per = labelled.groupBy("batch_id", "assigned").agg(
        F.count_if(F.col("modality") == "macro").alias("a"), F.count_if(F.col("modality") == "micro").alias("b")
    )
    known = F.col("assigned").isNotNull()
    hit = known & (F.col("a") > 0) & (F.col("b") > 0)
    return per.groupBy("batch_id").agg(
        F.sum(F.when(known, F.col("a") * F.col("b")).otherwise(0)).alias("pairs"),
        F.sum(F.when(hit, F.col("a") + F.col("b")).otherwise(0)).alias("anchors"),
    )


def _partials(labelled: DataFrame, policy: str, temperature: float, floor: float, genus_weight: float, normalize: bool, block_rows: int) -> DataFrame:
    """Per anchor and block: largest logit, weighted exp sum, positive logits, and the genus hinge."""
    columns = ["batch_id", "a_id", "peak", "total", "pos_sum", "pos_n", "hinge_sum", "hinge_n"]

    def matrix(column: pd.Series) -> np.ndarray:
        return unit_matrix(column) if normalize else np.stack(column.to_numpy()).astype(np.float64)

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=columns)
        sims = matrix(left["a_embedding"]) @ matrix(right["b_embedding"]).T
        same = lambda c: left[f"a_{c}"].to_numpy()[:, None] == right[f"b_{c}"].to_numpy()[None, :]
        cross = ~same("modality")
        exact, genus = cross & same("species"), cross & same("genus") & ~same("species")
        if policy == "genus_only":
            positive = genus
        else:
            known = left["a_assigned"].notna().to_numpy()[:, None] & right["b_assigned"].notna().to_numpy()[None, :]
            positive = cross & known & same("assigned")
        weight = np.ones_like(sims)
        if policy == "exact_plus_genus_relaxed_negative":
            weight[genus] = genus_weight
        if policy == "genus_only":
            weight[exact] = 0.0
        weight[positive] = 1.0
        weight[same("id")] = 0.0
        logits = sims / temperature
        peak = logits.max(axis=1)
        return pd.DataFrame(
            {
                "batch_id": left["batch_id"],
                "a_id": left["a_id"],
                "peak": peak,
                "total": (np.exp(logits - peak[:, None]) * weight).sum(axis=1),
                "pos_sum": np.where(positive, logits, 0.0).sum(axis=1),
                "pos_n": positive.sum(axis=1),
                "hinge_sum": np.where(genus, np.maximum(floor - sims, 0.0), 0.0).sum(axis=1),
                "hinge_n": genus.sum(axis=1),
            }
        )

    fields = ("id", "modality", "species", "genus", "assigned", "embedding")
    left = labelled.select("batch_id", *[F.col(c).alias(f"a_{c}") for c in fields])
    right = labelled.select("batch_id", *[F.col(c).alias(f"b_{c}") for c in fields])
    schema = "batch_id bigint, a_id string, peak double, total double, pos_sum double, pos_n bigint, hinge_sum double, hinge_n bigint"
    return block_join(left, right, kernel, schema, "a_id", "b_id", ["batch_id"], block_rows, block_rows)


def pair_losses(
    batches: DataFrame,
    policy: str = "exact_only",
    temperature: float = TEMPERATURE,
    base_temperature: float | None = None,
    floor: float = SIMILARITY_FLOOR,
    genus_weight: float = 0.5,
    normalize: bool = True,
    seed: int = 42,
    block_rows: int = 1024,
) -> DataFrame:
    """Per batch: contrastive loss over valid anchors and mean genus hinge, with their counts (0 when empty).

    Partial rows of an anchor merge with max-shifted sums, so block borders do not change the value.
    """
    parts = _partials(policy_labels(batches, policy, seed), policy, temperature, floor, genus_weight, normalize, block_rows)
    peaks = parts.groupBy("batch_id", "a_id").agg(
        F.max("peak").alias("_peak"),
        F.collect_list(F.struct("peak", "total")).alias("_t"),
        *[F.sum(c).alias(c) for c in ("pos_sum", "pos_n", "hinge_sum", "hinge_n")],
    )
    total = F.aggregate("_t", F.lit(0.0), lambda acc, x: acc + x["total"] * F.exp(x["peak"] - F.col("_peak")))
    log_total = F.log(F.greatest(total, F.lit(EPSILON))) + F.col("_peak")
    mean_log = F.col("pos_sum") / F.col("pos_n") - log_total
    scale = temperature / (base_temperature or temperature)
    anchors = peaks.withColumn("_loss", F.when(F.col("pos_n") > 0, -mean_log * scale))
    hinge = F.sum("hinge_sum") / F.sum("hinge_n")
    return anchors.groupBy("batch_id").agg(
        F.coalesce(F.avg("_loss"), F.lit(0.0)).alias("contrast_loss"),
        F.count("_loss").alias("anchors"),
        F.when(F.sum("hinge_n") > 0, hinge).otherwise(0.0).alias("genus_loss"),
        (F.sum("hinge_n") / 2).cast("bigint").alias("genus_pairs"),
    )


def policy_loss(batches: DataFrame, policy: str, contrast_weight: float = 1.0, genus_loss_weight: float = 0.1, **options) -> DataFrame:
    """Batch loss of a policy. The genus term counts under every policy but ``exact_only``."""
    losses = pair_losses(batches, policy, **options)
    genus = F.lit(0.0) if policy == "exact_only" else F.col("genus_loss") * float(genus_loss_weight)
    return losses.withColumn("loss", F.col("contrast_loss") * float(contrast_weight) + genus)


def view_consistency(items: DataFrame, left: str, right: str) -> DataFrame:
    """Mean cosine distance between two vectors of the same item, per modality and over all items."""
    per = items.groupBy("modality").agg(F.count(F.lit(1)).alias("n"), F.sum(cosine_distance(left, right)).alias("_d"))
    sides = F.array(F.struct(F.col("modality").alias("m")), F.struct(F.lit("all").alias("m")))
    rows = per.select(F.explode(sides).alias("x"), "n", "_d").groupBy(F.col("x.m").alias("modality")).agg(F.sum("n").alias("n"), F.sum("_d").alias("_d"))
    return rows.select("modality", "n", (F.col("_d") / F.col("n")).alias("distance"))
