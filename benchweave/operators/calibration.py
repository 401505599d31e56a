"""Confidence thresholds: coverage and precision over a fixed grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from benchweave.functions.names import to_col

STEPS = 200


def grid_bucket(confidence, steps: int = STEPS) -> Column:
    """Largest i with i/steps <= confidence, exact on the grid points themselves."""
    c = to_col(confidence).cast("double")
    guess = F.floor(c * steps)
    up = F.when((guess + 1) / float(steps) <= c, guess + 1).otherwise(guess)
    exact = F.when(up / float(steps) > c, up - 1).otherwise(up)
    inside = F.greatest(F.least(exact, F.lit(steps)), F.lit(-1))
    return F.when(c.isNull() | F.isnan(c), -1).otherwise(inside).cast("bigint")


def bucket_counts(predictions: DataFrame, steps: int = STEPS, confidence: str = "confidence", correct: str = "correct") -> DataFrame:
    """At most ``steps + 1`` rows, whatever the number of predictions."""
    return predictions.groupBy(grid_bucket(confidence, steps).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(correct).cast("bigint")).alias("n_correct")
    )


def _curve(rows: DataFrame, steps: int) -> DataFrame:
    return rows.select(
        (F.col("bucket") / float(steps)).alias("tau"),
        F.when(F.col("_total") > 0, F.col("_kept") / F.col("_total")).alias("coverage"),
        F.when(F.col("_kept") > 0, F.col("_right") / F.col("_kept")).alias("precision"),
        (F.col("_total") - F.col("_kept")).alias("n_flagged"),
    )


def calibrate(predictions: DataFrame, steps: int = STEPS) -> DataFrame:
    """tau, coverage, precision (NULL when nothing is kept) and flagged count for tau = 0, 1/steps, ... 1.

    Predictions are counted per grid bucket; the cumulative window then runs over the grid, not the predictions. A
    confidence that is negative, NaN or NULL is kept by no threshold and stays in the total.
    """
    counts = bucket_counts(predictions, steps)
    grid = predictions.sparkSession.range(-1, steps + 1).select(F.col("id").alias("bucket"))
    full = grid.join(counts, "bucket", "left").na.fill(0, ["n", "n_correct"])
    return _curve(cumulative_kept(full).where("bucket >= 0"), steps)


def cumulative_kept(buckets: DataFrame) -> DataFrame:
    """Reverse running counts over grid buckets."""
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(F.lit(0))
    return buckets.withColumns(
        {"_kept": F.sum("n").over(above), "_right": F.sum("n_correct").over(above), "_total": F.sum("n").over(whole)}
    )


def threshold_join(predictions: DataFrame, steps: int = STEPS) -> DataFrame:
    """Kept and correct counts per tau through the join ``confidence >= tau``, taken on bucket counts.

    Both sides have at most ``steps + 1`` rows.
    """
    counts = bucket_counts(predictions, steps)
    grid = predictions.sparkSession.range(steps + 1).select(F.col("id").alias("i"))
    kept = grid.join(counts, F.col("bucket") >= F.col("i"), "left").groupBy("i")
    return kept.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_kept"), F.coalesce(F.sum("n_correct"), F.lit(0)).alias("n_correct")).select(
        (F.col("i") / float(steps)).alias("tau"), "n_kept", "n_correct"
    )


def pick_threshold(curve: DataFrame, targets: list[float]) -> DataFrame:
    """Per target precision the smallest tau that reaches it, even if precision dips later; NULLs when none does."""
    found = F.struct("tau", "coverage", "precision", "n_flagged")
    row = curve.agg(*[F.min(F.when(F.col("precision") >= t, found)).alias(f"_{i}") for i, t in enumerate(targets)])
    picks = F.array(*[F.struct(F.lit(float(t)).alias("target"), F.col(f"_{i}").alias("p")) for i, t in enumerate(targets)])
    out = row.select(F.explode(picks).alias("x"))
    return out.select(
        "x.target",
        F.col("x.p.tau").alias("tau"),
        F.col("x.p.coverage").alias("coverage"),
        F.col("x.p.precision").alias("precision"),
        F.col("x.p.n_flagged").alias("n_flagged"),
        (1 - F.col("x.p.coverage")).alias("pct_flagged"),
    )
