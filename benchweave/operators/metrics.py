"""Classification metrics, loss means, weights, latency and multi-seed summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchweave.functions.names import to_col
from benchweave.functions.text import mean_std_text
from benchweave.operators.ranking import percentiles

# Weights of the trade-off score and the number of runs a summary expects.
TRADEOFF_WEIGHTS = (0.8, 0.2)
EXPECTED_SEEDS = 3


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, zero when the denominator is zero."""
    return F.when(denominator > 0, numerator / denominator).otherwise(0.0)


def confusion(predictions: DataFrame, true: str = "true_label", pred: str = "pred_label") -> DataFrame:
    return predictions.groupBy(true, pred).agg(F.count(F.lit(1)).alias("n"))


def confusion_wide(counts: DataFrame, classes: Sequence, true: str = "true_label", pred: str = "pred_label") -> DataFrame:
    """One row per true class and one column per predicted class; the class list is given, so nothing is probed."""
    cells = [F.coalesce(F.sum(F.when(F.col(pred) == c, F.col("n"))), F.lit(0)).alias(f"pred_{c}") for c in classes]
    return counts.groupBy(true).agg(*cells)


def per_class(counts: DataFrame, classes: DataFrame | None = None, true: str = "true_label", pred: str = "pred_label") -> DataFrame:
    """Support, TP, FP, FN, precision, recall and F1 per class; undefined ratios are zero.

    ``counts`` is the confusion table; each cell gives one row to its true class and one to its predicted class,
    so a single aggregate serves both. ``classes`` (column ``class_index``) adds classes never seen.
    """
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col(true) == F.col(pred), F.col("n")).otherwise(zero)
    sides = F.array(
        F.struct(F.col(true).alias("c"), F.col("n").alias("s"), zero.alias("p"), hit.alias("t")),
        F.struct(F.col(pred).cast(counts.schema[true].dataType).alias("c"), zero.alias("s"), F.col("n").alias("p"), zero.alias("t")),
    )
    cells = counts.select(F.explode(sides).alias("x"))
    sums = cells.groupBy(F.col("x.c").alias("class_index")).agg(F.sum("x.s").alias("support"), F.sum("x.p").alias("_predicted"), F.sum("x.t").alias("true_positives"))
    if classes is not None:
        sums = classes.select("class_index").distinct().join(sums, "class_index", "left").na.fill(0)
    precision = ratio(F.col("true_positives"), F.col("_predicted"))
    recall = ratio(F.col("true_positives"), F.col("support"))
    out = sums.withColumn("precision", precision).withColumn("recall", recall)
    return out.select(
        "class_index",
        "support",
        "true_positives",
        (F.col("_predicted") - F.col("true_positives")).alias("false_positives"),
        (F.col("support") - F.col("true_positives")).alias("false_negatives"),
        "precision",
        "recall",
        ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"),
    )


def classification_summary(classes: DataFrame) -> DataFrame:
    """Top-1, macro-F1 and balanced accuracy from the per-class table; classes without support do not count."""
    present = F.col("support") > 0
    total, correct = F.sum("support"), F.sum("true_positives")
    return classes.agg(
        F.coalesce(total, F.lit(0)).alias("sample_count"),
        F.coalesce(correct, F.lit(0)).alias("correct_count"),
        F.count(F.lit(1)).alias("num_classes"),
        (F.coalesce(correct, F.lit(0)) / F.greatest(F.coalesce(total, F.lit(0)), F.lit(1))).alias("top1_accuracy"),
        F.coalesce(F.avg(F.when(present, F.col("f1"))), F.lit(0.0)).alias("macro_f1"),
        F.coalesce(F.avg(F.when(present, F.col("recall"))), F.lit(0.0)).alias("balanced_accuracy"),
    )


def weighted_mean(value, weight) -> Column:
    """sum(value * weight) / sum(weight), NULL at zero weight."""
    w = to_col(weight)
    total = F.sum(w)
    return F.when(total > 0, F.sum(to_col(value) * w) / total)


def mean_loss(steps: DataFrame, keys: Sequence[str] = (), loss: str = "loss", size: str = "batch_size") -> DataFrame:
    """Mean loss over batches, weighed by their samples; batches without a loss do not count, and NULL without any."""
    counted = F.when(F.col(loss).isNotNull(), F.col(size))
    return steps.groupBy(*keys).agg(weighted_mean(loss, counted).alias("mean_loss"), F.coalesce(F.sum(counted), F.lit(0)).alias("loss_weight"))


def loss_means(steps: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Running loss means over steps.

    Sample losses weigh by samples. Pair losses add at least one in the numerator but only real anchors or pairs in
    the denominator, as the accumulators they replace did.
    """
    macro, micro = F.col("macro_samples"), F.col("micro_samples")
    both = macro + micro

    def paired(value: str, count: str) -> Column:
        weight = F.sum(F.greatest(F.lit(0), F.col(count)))
        return F.when(weight > 0, F.sum(F.col(value) * F.greatest(F.lit(1), F.col(count))) / weight)

    return steps.groupBy(*keys).agg(
        weighted_mean("total_loss", both).alias("total_loss"),
        weighted_mean("macro_loss", macro).alias("macro_loss"),
        weighted_mean("micro_loss", micro).alias("micro_loss"),
        paired("contrast_loss", "anchors").alias("contrast_loss"),
        paired("genus_loss", "genus_pairs").alias("genus_loss"),
        F.sum("macro_samples").alias("macro_samples"),
        F.sum("micro_samples").alias("micro_samples"),
        F.sum("anchors").alias("anchors"),
        F.sum("genus_pairs").alias("genus_pairs"),
        F.count(F.lit(1)).alias("steps"),
    )


def class_weights(counts: DataFrame, classes: DataFrame, on: str, n: str = "n") -> DataFrame:
    """Balanced weights total / (classes * count), zero for classes without rows."""
    full = classes.select(on).distinct().join(counts.select(on, n), on, "left").withColumn(n, F.coalesce(F.col(n), F.lit(0)))
    totals = full.agg(F.sum(n).alias("_total"), F.count(F.lit(1)).alias("_k")).first()
    total, k = float(totals["_total"] or 0), float(totals["_k"])
    return full.withColumn("weight", F.when(F.col(n) > 0, F.lit(total) / (F.lit(k) * F.col(n))).otherwise(0.0))


def inverse_frequency(n, power: float = 0.5) -> Column:
    if power < 0:
        raise ValueError("power must not be negative")
    return F.lit(1.0) / F.pow(F.greatest(F.lit(1), to_col(n)).cast("double"), F.lit(float(power)))


def branch_blend(macro, micro, macro_weight: float = 0.5, micro_weight: float = 0.5) -> Column:
    """Weighted mean of two branch metrics, weights renormalised over the branches that have a value."""
    a, b = to_col(macro), to_col(micro)
    wa = F.when(a.isNotNull(), F.lit(float(macro_weight))).otherwise(0.0)
    wb = F.when(b.isNotNull(), F.lit(float(micro_weight))).otherwise(0.0)
    total = wa + wb
    blend = wa / total * F.coalesce(a, F.lit(0.0)) + wb / total * F.coalesce(b, F.lit(0.0))
    return F.when(total > 0, blend).otherwise(0.0)


def tradeoff(macro, micro) -> Column:
    return branch_blend(macro, micro, *TRADEOFF_WEIGHTS)


def mean_of_branches(macro, micro) -> Column:
    return branch_blend(macro, micro, 1.0, 1.0)


def latency_summary(runs: DataFrame, keys: Sequence[str] = ("run",), value: str = "latency_ms") -> DataFrame:
    """Mean, sample deviation (zero for one run), median, 5th/95th percentile, extremes per key."""
    keys = list(keys)
    plain = runs.groupBy(*keys).agg(
        F.avg(value).alias("mean_ms"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std_ms"),
        F.min(value).alias("min_ms"),
        F.max(value).alias("max_ms"),
    )
    points = percentiles(runs, keys, value, {"median_ms": 0.5, "p05_ms": 0.05, "p95_ms": 0.95})
    return plain.join(points, keys)


def seed_summary(rows: DataFrame, models: DataFrame, metrics: Sequence[str], expected: int = EXPECTED_SEEDS) -> DataFrame:
    """Per listed model: finished seeds, "mean ± sd" in percent per metric, and a warning when seeds are missing."""
    aggs = [F.count_distinct(F.when(F.col("seed").isNotNull(), F.col("seed"))).alias("_seeds")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"_{m}_mean"), F.stddev_samp(m).alias(f"_{m}_sd")]
    done = rows.groupBy("model").agg(*aggs)
    full = models.join(done, "model", "left")
    seeds = F.coalesce("_seeds", F.lit(0))
    label = F.col("display_name") if "display_name" in models.columns else F.col("model")
    warning = F.when(seeds >= expected, "").otherwise(
        F.concat(F.lit("WARNING: "), label, F.lit(" has only "), seeds.cast("string"), F.lit(f"/{expected} seeds"))
    )
    return full.select(
        *models.columns,
        seeds.alias("n_seeds_completed"),
        *[mean_std_text(f"_{m}_mean", f"_{m}_sd").alias(m) for m in metrics],
        warning.alias("warning"),
    )


def join_run_metrics(training: DataFrame, macro: DataFrame, micro: DataFrame, alignment: DataFrame, retrieval: DataFrame) -> DataFrame:
    """One row per (model, seed) with every record's metrics; a run without retrieval or evaluation keeps NULLs."""
    on = ["model", "seed"]
    name = lambda df, prefix: df.select(*on, *[F.col(c).alias(prefix + c) for c in df.columns if c not in on])
    out = training.join(name(macro, "macro_"), on, "left").join(name(micro, "micro_"), on, "left")
    return out.join(alignment, on, "left").join(retrieval, on, "left")
