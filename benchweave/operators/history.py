"""Best-so-far metrics and early stopping over long metric histories."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchweave.functions.names import to_col
from benchweave.operators.ranking import row_numbers, running_max, running_total
from benchweave.session import cut_lineage

RECORDS_PER_PIECE = 8192


def _sign(mode: str) -> float:
    if mode not in ("max", "min"):
        raise ValueError("mode must be max or min")
    return 1.0 if mode == "max" else -1.0


def number_epochs(history: DataFrame, run: str, order: Sequence, out: str = "epoch") -> DataFrame:
    """Positions 0..n-1 of each run in ``order``, kept on shared storage for the passes that follow."""
    return cut_lineage(row_numbers(history, [run], order, "_e").withColumn(out, F.col("_e") - 1).drop("_e"))


def epoch_bucket(epoch: str) -> Column:
    """Whole epochs in pieces of 8,192: rises with the epoch and bounds the rows per run and piece."""
    return F.floor(F.col(epoch) / 8192).cast("bigint")


def running_best(history: DataFrame, run: str = "run", epoch: str = "epoch", metric: str = "metric", mode: str = "max") -> DataFrame:
    """Adds ``improved`` (strictly better than all before), ``best_metric`` and ``best_epoch`` so far.

    A NULL or NaN metric never improves; before the first number both bests are NULL.
    """
    sign = F.lit(_sign(mode))
    # The earliest epoch wins among equal values because only a strict improvement replaces the best.
    value = to_col(metric)
    mark = F.when(value.isNotNull() & ~F.isnan(value), F.struct((value * sign).alias("m"), (-to_col(epoch)).alias("e")))
    ranked = running_max(history.withColumn("_mark", mark), [run], [epoch], "_mark", "_before", epoch_bucket(epoch))
    improved = F.col("_mark").isNotNull() & (F.col("_before").isNull() | (F.col("_mark.m") > F.col("_before.m")))
    best = F.greatest("_mark", "_before")
    out = ranked.withColumns(
        {"improved": improved.cast("int"), "best_metric": best["m"] * sign, "best_epoch": (-best["e"]).cast("bigint")}
    )
    return out.drop("_mark", "_before")


def accepted_bests(
    history: DataFrame, min_delta: float, run: str = "run", epoch: str = "epoch", metric: str = "metric", mode: str = "max", piece: int = RECORDS_PER_PIECE
) -> DataFrame:
    """Rows accepted as a new best when an improvement must exceed ``min_delta`` over the last accepted one.

    An accepted row always beats every earlier row, so only rows with a new record matter. A run's records are cut into
    pieces of ``piece`` rows, and each piece is walked by itself once its first accepted row is known
    (``_piece_entries``), so that one long run spreads over tasks.
    """
    if not min_delta >= 0:
        raise ValueError("min_delta must not be negative")
    sign = _sign(mode)
    records = running_best(history, run, epoch, metric, mode).where(F.col("improved") == 1)
    records = records.select(F.col(run).alias("_run"), F.col(epoch).alias("_epoch"), F.col(metric).alias("_metric"), (F.col(metric) * sign).cast("double").alias("_m"))
    steps = row_numbers(records, ["_run"], ["_epoch"], "_i", bucket=epoch_bucket("_epoch")).withColumn("_i", F.col("_i") - 1)
    steps = cut_lineage(steps.withColumn("_part", F.floor(F.col("_i") / piece)))
    entries = steps.where("_i = 0").select("_run", "_part", F.col("_i").alias("_start"))
    if (steps.agg(F.max("_i")).first()[0] or 0) >= piece:
        entries = entries.unionByName(_piece_entries(steps, float(min_delta)))
    lined = steps.join(entries, ["_run", "_part"]).where("_i >= _start").repartition("_run", "_part").sortWithinPartitions("_run", "_part", "_i")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, best = None, None
        for batch in batches:
            keep = []
            for name, part, value in zip(batch["_run"], batch["_part"], batch["_m"]):
                if (name, part) != current:
                    current, best = (name, part), None
                fresh = best is None or value - best > min_delta
                best = value if fresh else best
                keep.append(fresh)
            yield batch[keep]

    accepted = lined.select("_run", "_part", "_epoch", "_metric", "_m").mapInPandas(walk, lined.select("_run", "_part", "_epoch", "_metric", "_m").schema)
    return accepted.select(F.col("_run").alias(run), F.col("_epoch").alias(epoch), F.col("_metric").alias(metric))


def least_accepted(best: np.ndarray, min_delta: float) -> np.ndarray:
    """For each best so far the smallest double whose difference to it exceeds ``min_delta``, as computed in doubles.

    Differences never fall as the value rises, so the doubles are halved in the order of their bits.
    """
    flip = lambda bits: bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))
    low = flip(np.ascontiguousarray(best, dtype=np.float64).view(np.int64))
    high = np.full_like(low, flip(np.array([np.inf]).view(np.int64))[0])
    with np.errstate(invalid="ignore", over="ignore"):
        for _ in range(64):
            middle = (low & high) + ((low ^ high) >> 1)
            enough = flip(middle).view(np.float64) - best > min_delta
            high, low = np.where(enough, middle, high), np.where(enough, low, middle)
    return flip(high).view(np.float64)


def _piece_entries(steps: DataFrame, min_delta: float) -> DataFrame:
    """(_run, _part, _start): the first accepted record of every later piece that has one.

    A record that is accepted in a piece fixes the best with which the piece ends, and that best fixes the next accepted
    record in a later piece: a hop. Which hops a run takes is found by doubling, so that the rounds follow the
    logarithm of its pieces. Hops are looked up by a running count of records below the bests' limits.
    """

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, current = [], None

        def finish() -> pd.DataFrame:
            rows = pd.concat(held)
            values = rows["_m"].to_numpy()
            after = np.searchsorted(values, least_accepted(values, min_delta))
            last = values.copy()
            for i in range(len(values) - 1, -1, -1):
                if i < after[i] < len(values):
                    last[i] = last[after[i]]
            return rows.assign(_end=last, _limit=least_accepted(last, min_delta)).drop(columns="_m")

        for batch in batches:
            for key, rows in batch.groupby(["_run", "_part"], sort=False):
                if held and key != current:
                    yield finish()
                    held.clear()
                current = key
                held.append(rows)
        if held:
            yield finish()

    lined = steps.select("_run", "_part", "_i", "_m").repartition("_run", "_part").sortWithinPartitions("_run", "_part", "_i")
    schema = lined.drop("_m").withColumn("_end", F.lit(0.0)).withColumn("_limit", F.lit(0.0)).schema
    walked = cut_lineage(lined.mapInPandas(ends, schema))
    limits = walked.select("_run", "_limit").distinct()
    marks = steps.select("_run", F.col("_m").alias("_limit"), F.lit(1).alias("_kind")).unionByName(limits.withColumn("_kind", F.lit(0)))
    below = running_total(marks, ["_run"], ["_limit", "_kind"], "_kind", "_next").where("_kind = 0").drop("_kind")
    places = steps.select("_run", F.col("_i").alias("_next"), F.col("_part").alias("_next_part"))
    hops = walked.join(below, ["_run", "_limit"]).join(places, ["_run", "_next"]).where("_next_part > _part").select("_run", "_i", "_next")
    hops = cut_lineage(hops)
    # Only records that some hop leads to, and the first ones, can begin a piece.
    starts = hops.select("_run", F.col("_next").alias("_i")).union(hops.where("_i = 0").select("_run", "_i")).distinct()
    jump = cut_lineage(hops.join(starts, ["_run", "_i"]))
    reached = hops.where("_i = 0").select("_run", "_i")
    while True:
        # After k rounds all records within 2^k - 1 hops are reached, and a jump is 2^k hops.
        more = cut_lineage(reached.join(jump, ["_run", "_i"]).select("_run", F.col("_next").alias("_i")))
        if more.isEmpty():
            break
        reached = cut_lineage(reached.union(more).distinct())
        onward = jump.select("_run", F.col("_i").alias("_next"), F.col("_next").alias("_far"))
        jump = cut_lineage(jump.join(onward, ["_run", "_next"]).select("_run", "_i", F.col("_far").alias("_next")))
    return reached.where("_i > 0").join(steps, ["_run", "_i"]).select("_run", "_part", F.col("_i").alias("_start"))


def early_stop(history: DataFrame, patience: int, run: str = "run", epoch: str = "epoch", metric: str = "metric", mode: str = "max", min_delta: float = 0.0) -> DataFrame:
    """Per run: best epoch and value when training stops, the stop epoch (NULL if patience is never hit), epochs seen.

    ``epoch`` counts 0, 1, 2, ... within a run. Waiting time is the distance to the last accepted epoch.
    """
    if min_delta > 0:
        accepted = accepted_bests(history, min_delta, run, epoch, metric, mode).select(run, epoch, F.lit(1).alias("_ok"))
        marked = history.join(cut_lineage(accepted), [run, epoch], "left")
        last = F.when(F.col("_ok") == 1, F.struct(F.col(epoch).alias("e"), F.col(metric).alias("m")))
        ranked = running_max(marked.withColumn("_last", last), [run], [epoch], "_last", "_before", epoch_bucket(epoch))
        spot = F.coalesce("_last", "_before")
        rows = ranked.withColumns({"best_epoch": spot["e"], "best_metric": spot["m"]})
    else:
        rows = running_best(history, run, epoch, metric, mode)
    waited = F.col(epoch) - F.col("best_epoch")
    stop = F.min(F.when(waited >= patience, F.struct(F.col(epoch).alias("e"), F.col("best_epoch").alias("b"), F.col("best_metric").alias("m"))))
    end = F.max_by(F.struct(F.col("best_epoch").alias("b"), F.col("best_metric").alias("m")), F.col(epoch))
    out = rows.groupBy(run).agg(stop.alias("_s"), end.alias("_e"), F.count(F.lit(1)).alias("epochs"))
    return out.select(
        run,
        F.coalesce("_s.b", "_e.b").cast("bigint").alias("best_epoch"),
        F.coalesce("_s.m", "_e.m").alias("best_metric"),
        F.col("_s.e").alias("stop_epoch"),
        "epochs",
    )


