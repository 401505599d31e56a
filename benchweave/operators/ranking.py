"""Orders and running sums that never put a whole group into one task.

A window over a key runs each key in one task, so a key that holds a third of all rows stalls the job. Here every
group is cut into ordered buckets: the window runs inside (key, bucket), and a small table with one row per
(key, bucket) supplies what the earlier buckets of the same key add up to.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from benchweave.functions.names import to_col
from benchweave.session import cut_lineage, small_side, spread

SAMPLE_PER_BUCKET = 32
MAX_BUCKETS = 256
FEW_VALUES = 1 << 16
DIGITS = 1 << 16


def range_bucket(df: DataFrame, order: Sequence, buckets: int | None = None) -> Column:
    """Bucket number that rises with ``order`` (ascending columns), from boundaries of a bounded hash sample.

    The sample is the rows with the smallest hashes of order value and place, so that a value repeated over many keys
    takes no more than its share: exact in size, and taken with a top-n that keeps only ``buckets * 32`` rows per task
    and on the driver. Boundaries only decide how work is cut, never results.
    """
    count = buckets or spread(df, MAX_BUCKETS)
    key = F.struct(*[to_col(c).alias(f"o{i}") for i, c in enumerate(order)])
    sample = df.select(key.alias("k")).orderBy(F.xxhash64("k", F.monotonically_increasing_id())).limit(count * SAMPLE_PER_BUCKET)
    rows = [r["k"] for r in sample.orderBy("k").collect()]
    step = max(1, len(rows) // count)
    bounds = []
    for row in rows[step::step]:
        if not bounds or row != bounds[-1]:
            bounds.append(row)
    if not bounds:
        return F.lit(0)
    types = [f.dataType for f in df.select(key.alias("k")).schema["k"].dataType.fields]
    if len(order) == 1:
        probe = to_col(order[0])
        literals = [F.lit(row[0]).cast(types[0]) for row in bounds]
    else:
        probe = key
        literals = [F.struct(*[F.lit(v).cast(t).alias(f"o{i}") for i, (v, t) in enumerate(zip(row, types))]) for row in bounds]

    def search(low: int, high: int) -> Column:
        """Nested comparisons: log2(buckets) tests per row, inside generated code."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(probe >= literals[middle], search(middle + 1, high)).otherwise(search(low, middle))

    return search(0, len(literals))


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence,
    value=None,
    out: str = "running",
    bucket: Column | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Inclusive running sum of ``value`` (1 by default) per ``keys`` in ``order``; ``order`` must be total.

    ``bucket`` may give any integer that never falls along ``order``; without it boundaries are sampled.
    Keys must not be NULL.
    """
    keys = list(keys)
    amount = F.lit(1).cast("bigint") if value is None else to_col(value)
    cut = bucket if bucket is not None else range_bucket(df, order, buckets)
    base = df.withColumn("_cut", cut).withColumn("_amount", amount)
    parts = base.groupBy(*keys, "_cut").agg(F.sum("_amount").alias("_part"))
    before = Window.partitionBy(*keys).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*keys, "_cut", F.coalesce(F.sum("_part").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_cut").orderBy(*[to_col(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    ranked = base.withColumn("_inside", F.sum("_amount").over(inside))
    joined = ranked.join(offsets, [*keys, "_cut"])
    return joined.withColumn(out, F.col("_inside") + F.col("_offset")).select(*df.columns, out)


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence, out: str = "rn", **options) -> DataFrame:
    """``row_number`` per key for groups of any size."""
    return running_total(df, keys, order, None, out, **options)


def dense_index(df: DataFrame, order: Sequence, out: str = "row_index") -> DataFrame:
    """Positions 0..n-1 over the whole table."""
    return row_numbers(df, [], order, "_rn").withColumn(out, F.col("_rn") - 1).drop("_rn")


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence, k: int, out: str = "rn") -> DataFrame:
    """First ``k`` rows per key. The rank filter is applied per task before the shuffle, so hot keys stay small."""
    window = Window.partitionBy(*keys).orderBy(*[to_col(c) for c in order])
    return df.withColumn(out, F.row_number().over(window)).where(F.col(out) <= k)


def running_max(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence,
    value,
    out: str = "best_before",
    bucket: Column | None = None,
) -> DataFrame:
    """Largest ``value`` strictly before each row of its key (NULL on the first row)."""
    keys = list(keys)
    cut = bucket if bucket is not None else range_bucket(df, order)
    base = df.withColumn("_cut", cut).withColumn("_amount", to_col(value))
    parts = base.groupBy(*keys, "_cut").agg(F.max("_amount").alias("_part"))
    before = Window.partitionBy(*keys).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*keys, "_cut", F.max("_part").over(before).alias("_offset"))
    inside = Window.partitionBy(*keys, "_cut").orderBy(*[to_col(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    ranked = base.withColumn("_inside", F.max("_amount").over(inside))
    joined = ranked.join(offsets, [*keys, "_cut"])
    return joined.withColumn(out, F.greatest("_inside", "_offset")).select(*df.columns, out)


def _magnitude(value: Column) -> Column:
    """A digit that rises with a double: its sign and binary exponent, with places for zero, the infinities and NaN."""
    power = F.floor(F.log2(F.abs(value))).cast("int") + 1200
    inf = float("inf")
    return F.when(F.isnan(value), 5000).when(value == inf, 4000).when(value == -inf, -4000).when(value == 0, 0).when(value > 0, power).otherwise(-power)


def _histogram(rows: DataFrame, place: Sequence[str], base: Column) -> DataFrame:
    """Per place and ``_digit``: rows before it, rows, distinct values, least and most value. Digits per place are few."""
    parts = rows.groupBy(*place, "_digit").agg(
        F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_distinct"), F.min("_v").alias("_least"), F.max("_v").alias("_most")
    )
    before = Window.partitionBy(*place).orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)) + base)


def select_ranks(counts: DataFrame, keys: Sequence[str], ranks: DataFrame, few: int = FEW_VALUES) -> DataFrame:
    """``ranks`` with ``_v``, the value at ``_rank`` (from 0) among the rows of its key; exact, without sorting the rows.

    ``counts`` holds every distinct double ``_v`` of a key once, with its number of rows ``_n``. The values are counted
    by sign and exponent; only the digit that holds a wanted rank is looked into, cut into ``DIGITS`` equal ranges each
    time, until it holds at most ``few`` distinct values, which are then put in order. Within one exponent three cuts reach
    single values, so the rounds are few whatever the distribution. All keys and ranks share the rounds.
    """
    keys, bounds = list(keys), ["_least", "_most"]
    first = _histogram(counts.withColumn("_digit", _magnitude(F.col("_v"))), keys, F.lit(0))
    hit = (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_rows"))
    found = cut_lineage(small_side(ranks).join(first, keys).where(hit).drop("_digit"))
    inside = lambda places: counts.join(small_side(places), keys).where(F.col("_v").between(F.col("_least"), F.col("_most")))
    wide = (F.col("_distinct") > few) & (F.col("_least") < F.col("_most"))
    done = None
    while not (still := found.where(wide)).isEmpty():
        closed = found.where(~wide)
        done = closed if done is None else done.union(closed)
        places = still.select(*keys, F.col("_before").alias("_base"), *bounds).distinct()
        share = (F.col("_v") - F.col("_least")) / (F.col("_most") - F.col("_least"))
        rows = inside(places).withColumn("_digit", F.least(F.floor(share * DIGITS).cast("int"), F.lit(DIGITS - 1)))
        rows = rows.withColumnsRenamed({"_least": "_from", "_most": "_to"})
        place = [*keys, "_base", "_from", "_to"]
        finer = _histogram(rows, place, F.col("_base")).withColumnsRenamed({"_base": "_above"})
        asked = still.select(*ranks.columns, F.col("_before").alias("_above"))
        found = cut_lineage(asked.join(finer, [*keys, "_above"]).where(hit).select(*found.columns))
    done = found if done is None else done.union(found)
    single = F.col("_least") == F.col("_most")
    places = done.where(~single).select(*keys, F.col("_before").alias("_base"), *bounds).distinct()
    line = Window.partitionBy(*keys, "_base").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ordered = inside(places).withColumn("_upto", F.col("_base") + F.sum("_n").over(line)).select(*keys, "_base", "_v", "_n", "_upto")
    asked = done.where(~single).select(*ranks.columns, F.col("_before").alias("_base"))
    at = (F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_n"))
    picked = asked.join(ordered, [*keys, "_base"]).where(at).select(*ranks.columns, "_v")
    return done.where(single).select(*ranks.columns, F.col("_least").alias("_v")).union(picked)


def percentiles(df: DataFrame, keys: Sequence[str], value: str, points: dict[str, float], few: int = FEW_VALUES) -> DataFrame:
    """Exact linear-interpolation percentiles per key, as doubles; NaN counts as the largest value, NULL not at all.

    Equal values are counted first; ``select_ranks`` then finds the values at the two ranks beside each percentile, so
    neither a task nor a sort holds a group's values.
    """
    keys = list(keys)
    if not keys:
        raise ValueError("percentiles needs at least one key column")
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    counts = cut_lineage(counts)  # read by the totals and by every round
    at = {name: (F.col("_total") - 1) * F.lit(float(p)) for name, p in points.items()}
    wanted = [
        F.struct(F.lit(f"{name}{side}").alias("_name"), edge(rank).cast("bigint").alias("_rank"), (rank - F.floor(rank)).alias("_w"))
        for name, rank in at.items()
        for side, edge in (("_lo", F.floor), ("_hi", F.ceil))
    ]
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    ranks = totals.select(*keys, F.explode(F.array(*wanted)).alias("x")).select(*keys, "x.*")
    chosen = select_ranks(counts, keys, ranks, few)
    aggs = [F.max(F.when(F.col("_name") == f"{n}{side}", F.col("_v"))).alias(f"_{n}{side}") for n in points for side in ("_lo", "_hi")]
    weights = [F.max(F.when(F.col("_name") == f"{n}_lo", F.col("_w"))).alias(f"_{n}_w") for n in points]
    # A weight of zero leaves the lower value alone, also beside an infinite one.
    blend = lambda n: F.when(F.col(f"_{n}_w") == 0, F.col(f"_{n}_lo")).otherwise(
        F.col(f"_{n}_lo") * (F.lit(1.0) - F.col(f"_{n}_w")) + F.col(f"_{n}_hi") * F.col(f"_{n}_w")
    )
    return chosen.groupBy(*keys).agg(*aggs, *weights).select(*keys, *[blend(n).alias(n) for n in points])
