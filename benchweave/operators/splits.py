"""Leak-free grouped train/val/test splits, their repair rounds and their reports.

A group (one physical specimen) goes to one split as a whole. Per stratum (entity, modality) the largest group seeds
train and the two smallest seed the hold-outs; the rest is ordered by hash and cut where its running size crosses the
quotas. Everything is aggregates and bucketed running sums, so results do not depend on input order or partitioning
and no stratum is one task's work.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from benchweave.functions.hashing import hex_prefix, stable_hash
from benchweave.functions.names import non_blank
from benchweave.operators.ranking import row_numbers, top_rows
from benchweave.schemas import CLASS_COUNT_COLUMNS, MODALITIES, PHASES, SPLITS
from benchweave.session import cut_lineage, keep_table, small_side

STRATUM = ["species", "modality"]
# Default ratios, weights of the distribution error, tolerated ratio deviation.
DEFAULT_RATIOS = {"train": 0.70, "val": 0.15, "test": 0.15}
MODALITY_WEIGHT = 0.35
PHASE_WEIGHT = 0.20
RATIO_TOLERANCE = 0.01
# Leading hash digits that make a cut: a stratum has 4,096 of them at most.
CUT_DIGITS = 3
# Classes of groups that one repair pass brings to the driver.
CLASSES_PER_PASS = 20_000
# Smallest gain in distribution error that counts as one.
LEAST_GAIN = 1e-12


def check_ratios(ratios: Mapping[str, float]) -> dict[str, float]:
    """The ratios in split order; each split has one, all lie in (0, 1], and they add up to one."""
    shares = {s: float(ratios[s]) if s in ratios else math.nan for s in SPLITS}
    unknown = sorted(set(ratios) - set(SPLITS))
    unfit = sorted(s for s, share in shares.items() if not 0 < share <= 1)
    rest = 1 - math.fsum(shares.values())
    if unknown or unfit or abs(rest) > 1e-9:
        raise ValueError(f"bad split ratios: unknown {unknown}, not in (0, 1] {unfit}, missing from one {rest:.9f}")
    return shares


def group_units(samples: DataFrame, key: str = "group_key") -> DataFrame:
    """One row per group: size and rows per phase. Both levels reduce before they shuffle."""
    per_phase = samples.groupBy(key, *STRATUM, "phase").agg(F.count(F.lit(1)).alias("_n"), F.max("protocol_group").alias("_g"))
    named = F.collect_list(F.when(F.col("phase") != "", F.struct("phase", "_n")))
    return per_phase.groupBy(key, *STRATUM).agg(
        F.max("_g").alias("protocol_group"), F.sum("_n").alias("size"), F.map_from_entries(F.array_sort(named)).alias("phase_counts")
    )


def group_sizes(samples: DataFrame, key: str = "group_key") -> DataFrame:
    """One row per group: size and samples of the fixed phases. Numbers only, so that one hashed level does; enough for
    ``quota_cuts`` and ``group_summary``."""
    return samples.groupBy(key, *STRATUM).agg(F.count(F.lit(1)).alias("size"), *[F.count_if(F.col("phase") == p).alias(p) for p in PHASES])


def _with_mix(units: DataFrame) -> DataFrame:
    if "_mix" in units.columns:
        return units
    return units.withColumn("_mix", F.array_sort(F.coalesce(F.map_entries("phase_counts"), F.array().cast("array<struct<key:string,value:bigint>>"))))


def _dimension_counts(units: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """(dimension, item, [extra], n): samples in total, per modality and per phase. Groups that look alike are counted first."""
    alike = _with_mix(units).groupBy(*extra, "modality", "size", "_mix").agg(F.count(F.lit(1)).alias("_c"))
    phases = F.transform("_mix", lambda e: F.struct(F.lit("phase").alias("d"), e["key"].alias("i"), (e["value"] * F.col("_c")).alias("n")))
    samples = F.col("size") * F.col("_c")
    fixed = F.array(
        F.struct(F.lit("total").alias("d"), F.lit("").alias("i"), samples.alias("n")),
        F.struct(F.lit("modality").alias("d"), F.col("modality").alias("i"), samples.alias("n")),
    )
    rows = alike.select(*extra, F.explode(F.concat(fixed, phases)).alias("x"))
    return rows.groupBy(F.col("x.d").alias("dimension"), F.col("x.i").alias("item"), *extra).agg(F.sum("x.n").alias("n"))


def targets(units: DataFrame, ratios: Mapping[str, float] = DEFAULT_RATIOS) -> DataFrame:
    """Quota of every split in total, per modality and per phase."""
    shares = F.array(*[F.struct(F.lit(s).alias("split"), F.lit(r).alias("ratio")) for s, r in check_ratios(ratios).items()])
    rows = _dimension_counts(units).withColumn("x", F.explode(shares))
    return rows.select("dimension", "item", "x.split", F.col("n").alias("total"), (F.col("n") * F.col("x.ratio")).alias("target"))


def split_counters(assigned: DataFrame) -> DataFrame:
    """Assigned samples per split in total, per modality and per phase."""
    return _dimension_counts(assigned, ["split"])


def presence(assigned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups per key and split."""
    return assigned.groupBy(*keys, "split").agg(F.count(F.lit(1)).alias("groups"))


def distribution_error(counters: DataFrame, quota: DataFrame) -> DataFrame:
    """One number: relative deviation from the quotas in total, plus 0.35 x modalities, plus 0.20 x phases."""
    joined = quota.join(counters, ["dimension", "item", "split"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    per_item = joined.groupBy("dimension", "item").agg((F.sum(F.abs(F.col("n") - F.col("target"))) / F.greatest(F.lit(1.0), F.sum("target"))).alias("e"))
    weight = F.when(F.col("dimension") == "modality", MODALITY_WEIGHT).when(F.col("dimension") == "phase", PHASE_WEIGHT).otherwise(1.0)
    return per_item.agg(F.sum(F.col("e") * weight).alias("error"))


def entity_order(units: DataFrame, seed: int = 42) -> DataFrame:
    """Entities by (groups, -samples, hash), numbered from 1."""
    sums = units.groupBy("species").agg(F.count(F.lit(1)).alias("n_groups"), F.sum("size").alias("samples"))
    ranked = sums.withColumn("_neg", -F.col("samples")).withColumn("_h", stable_hash(seed, "species"))
    return row_numbers(ranked, [], ["n_groups", "_neg", "_h"], "rank").drop("_neg", "_h")


def group_order(units: DataFrame, seed: int = 42) -> DataFrame:
    """Groups of each entity by (-size, hash), numbered from 1."""
    keyed = units.withColumn("_neg", -F.col("size")).withColumn("_h", stable_hash(seed, "group_key"))
    return row_numbers(keyed, ["species"], ["_neg", "_h"], "rank").drop("_neg", "_h")


def _val_first(seed: int) -> Column:
    """Whether val comes before test for an entity: last digit of its hold-out hash is 0-7."""
    return F.conv(F.substring(stable_hash(seed, "species", F.lit("holdout")), 16, 1), 16, 10).cast("int") < 8


def required_splits(units: DataFrame, seed: int = 42) -> DataFrame:
    """Splits an entity, and each of its modalities, must reach: three, train plus one, or train only."""
    per = units.groupBy(*STRATUM).agg(F.count(F.lit(1)).alias("n_groups"))
    whole = per.groupBy("species").agg(F.sum("n_groups").alias("n_groups")).withColumn("modality", F.lit(""))
    both = per.unionByName(whole)
    first = F.when(_val_first(seed) != (F.col("modality") == "micro"), "val").otherwise("test")
    wanted = F.when(F.col("n_groups") >= 3, F.lit("train,val,test")).when(F.col("n_groups") == 2, F.concat(F.lit("train,"), first)).otherwise("train")
    return both.select("species", "modality", "n_groups", wanted.alias("required"))


def _hash_cuts(hashed: DataFrame) -> DataFrame:
    """Per stratum and leading hash digits: groups, samples, and the least and most samples of a group. Numbers only, so that
    this is one hashed aggregate; all further steps look at a few cuts of a stratum."""
    sums = [F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_sum"), F.min("size").alias("_least"), F.max("size").alias("_most")]
    return hashed.groupBy(*STRATUM, "_cut").agg(*sums)


def _anchors(hashed: DataFrame, cuts: DataFrame, seed: int) -> DataFrame:
    """Per stratum: group count, the seed groups, where they lie, and the samples that are left after them.

    A group outside the three cuts that come first by (least size, cut) has three groups before it by (size, hash), and the
    largest group lies in the first cut that holds its size: no other rows are ordered.
    """
    totals = cuts.groupBy(*STRATUM).agg(F.sum("_n").alias("_n"), F.sum("_sum").alias("_total"))
    low_cuts = top_rows(cuts, STRATUM, ["_least", "_cut"], 3).select(*STRATUM, "_cut")
    top_cuts = top_rows(cuts, STRATUM, [F.desc("_most"), "_cut"], 1).select(*STRATUM, "_cut")
    near = hashed.select(*STRATUM, "size", "_h", "_cut", "group_key").join(small_side(low_cuts.union(top_cuts).distinct()), [*STRATUM, "_cut"])
    top = F.min(F.struct((-F.col("size")).alias("neg"), F.col("_h").alias("h"), F.col("group_key").alias("k"), F.col("_cut").alias("c")))
    whole = totals.join(near.groupBy(*STRATUM).agg(top.alias("_top")), STRATUM)
    small = top_rows(near, STRATUM, ["size", "_h", "group_key"], 3, "_r")
    others = small.join(whole, STRATUM).where(F.col("group_key") != F.col("_top.k"))
    spot = F.struct(F.col("_r").alias("r"), F.col("group_key").alias("k"), F.col("size").alias("s"), F.col("_cut").alias("c"))
    lows = others.groupBy(*STRATUM).agg(F.array_sort(F.collect_list(spot)).alias("_low"))
    out = whole.join(lows, STRATUM, "left")
    low = lambda i: F.get("_low", F.lit(i))
    kept = F.col("_n") >= 3
    place = lambda spot: F.struct(spot["c"].alias("c"), spot["s"].alias("s"))
    first = F.struct(F.col("_top.c").alias("c"), (-F.col("_top.neg")).alias("s"))
    return out.select(
        *STRATUM,
        "_n",
        F.col("_top.k").alias("_k0"),
        low(0)["k"].alias("_k1"),
        F.when(kept, low(1)["k"]).alias("_k2"),
        F.when(kept, F.col("_total") + F.col("_top.neg") - low(0)["s"] - low(1)["s"]).otherwise(0).alias("_left"),
        F.when(kept, F.array(first, place(low(0)), place(low(1)))).alias("_taken"),
    )


def _seed_split(seed: int) -> Column:
    val_first = _val_first(seed)
    opposite = (F.col("_n") == 2) & (F.col("modality") == "micro")
    first = F.when(val_first != opposite, "val").otherwise("test")
    second = F.when(val_first, "test").otherwise("val")
    key = F.col("group_key")
    return F.when(key == F.col("_k0"), "train").when(key == F.col("_k1"), first).when(key == F.col("_k2"), second)


def _with_hash(units: DataFrame, seed: int) -> DataFrame:
    hashed = units.withColumn("_h", stable_hash(seed, "group_key"))
    return hashed.withColumn("_cut", F.substring("_h", 1, CUT_DIGITS))


def _seeds(rows: DataFrame, anchors: DataFrame, seed: int) -> DataFrame:
    return rows.join(small_side(anchors), STRATUM).withColumn("_seed", _seed_split(seed))


def seed_groups(units: DataFrame, seed: int = 42) -> DataFrame:
    """The groups that guarantee coverage, with their splits."""
    hashed = keep_table(_with_hash(units, seed))
    anchors = cut_lineage(_anchors(hashed, cut_lineage(_hash_cuts(hashed)), seed))
    return _seeds(hashed, anchors, seed).where(F.col("_seed").isNotNull()).select(*units.columns, F.col("_seed").alias("split"))


def quota_cuts(units: DataFrame, ratios: Mapping[str, float] = DEFAULT_RATIOS, seed: int = 42) -> DataFrame:
    """Per stratum: its seed groups and the (hash, key) where val and test begin among the other groups.

    Running sizes rise with the hash, so that two places tell the split of every group, and samples need no join with the
    groups (``split_by_cuts``). They are found from sums per cut and the groups of the four cuts that can hold them.
    ``units`` needs group_key, species, modality and size; it is read once and kept with its hashes.
    """
    ratios = check_ratios(ratios)
    limits = {"_val": ratios["train"], "_test": ratios["train"] + ratios["val"]}
    hashed = keep_table(_with_hash(units.select("group_key", *STRATUM, "size"), seed))
    cuts = cut_lineage(_hash_cuts(hashed))
    anchors = cut_lineage(_anchors(hashed, cuts, seed))
    seeds = anchors.select(*STRATUM, F.explode("_taken").alias("x")).groupBy(*STRATUM, F.col("x.c").alias("_cut"))
    free = cuts.join(seeds.agg(F.sum("x.s").alias("_s"), F.count(F.lit(1)).alias("_t")), [*STRATUM, "_cut"], "left")
    free = free.withColumn("_free", F.col("_sum") - F.coalesce("_s", F.lit(0))).where("_n > coalesce(_t, 0)")
    line = Window.partitionBy(*STRATUM).orderBy("_cut").rowsBetween(Window.unboundedPreceding, 0)
    share = lambda reached: reached / F.greatest(F.col("_left"), F.lit(1))
    upto = free.withColumn("_upto", F.sum("_free").over(line)).join(anchors.select(*STRATUM, "_left").where("_left > 0"), STRATUM)
    # Where the sum first reaches a limit, its last group may still lie before it; the next cut's first group does not.
    reaches = [F.sum((share(F.col("_upto")) >= limit).cast("int")).over(line).between(1, 2) for limit in limits.values()]
    wanted = upto.select(*STRATUM, "_cut", (F.col("_upto") - F.col("_free")).alias("_offset"), (reaches[0] | reaches[1]).alias("_near")).where("_near").drop("_near")
    rows = _seeds(hashed.join(small_side(cut_lineage(wanted)), [*STRATUM, "_cut"]), anchors, seed).where(F.col("_seed").isNull())
    inside = Window.partitionBy(*STRATUM, "_cut").orderBy("_h", "group_key").rowsBetween(Window.unboundedPreceding, 0)
    middle = rows.withColumn("_at", share(F.sum("size").over(inside) + F.col("_offset") - F.col("size") / 2.0))
    places = [F.min(F.when(F.col("_at") >= limit, F.struct(F.col("_h").alias("h"), F.col("group_key").alias("k")))).alias(name) for name, limit in limits.items()]
    found = middle.groupBy(*STRATUM).agg(*places)
    return cut_lineage(anchors.select(*STRATUM, "_n", "_k0", "_k1", "_k2").join(found, STRATUM, "left"))


def split_by_cuts(rows: DataFrame, cuts: DataFrame, seed: int = 42) -> DataFrame:
    """Groups or samples (group_key, species, modality) with the split that ``quota_cuts`` gives their group."""
    place = F.struct(stable_hash(seed, "group_key").alias("h"), F.col("group_key").alias("k"))
    by_quota = F.when(F.col("_at") >= F.col("_test"), "test").when(F.col("_at") >= F.col("_val"), "val").otherwise("train")
    joined = _seeds(rows, cuts, seed).withColumn("_at", place)
    return joined.withColumn("split", F.coalesce("_seed", by_quota)).select(*rows.columns, "split")


def grouped_split(units: DataFrame, ratios: Mapping[str, float] = DEFAULT_RATIOS, seed: int = 42) -> DataFrame:
    """Groups with their split.

    The group table is read several times, so it is built once and kept on shared storage.
    """
    kept = keep_table(units)
    return split_by_cuts(kept, quota_cuts(kept, ratios, seed), seed)


def apply_split(samples: DataFrame, assigned: DataFrame, key: str = "group_key") -> DataFrame:
    """Samples with the split of their group."""
    return samples.join(assigned.select(key, "split"), key)


def apply_repaired(samples: DataFrame, cuts: DataFrame, repaired: DataFrame, seed: int = 42) -> DataFrame:
    """Samples with the repaired split of their group: that of ``quota_cuts``, but for the groups that the repair moved."""
    first = split_by_cuts(repaired.select("group_key", *STRATUM, F.col("split").alias("_to")), cuts, seed)
    moved = cut_lineage(first.where(F.col("_to") != F.col("split")).drop("split"))
    joined = split_by_cuts(samples, cuts, seed).join(small_side(moved), ["group_key", *STRATUM], "left")
    return joined.withColumn("split", F.coalesce("_to", "split")).select(*samples.columns, "split")


def leaks(rows: DataFrame, key: str = "group_key") -> DataFrame:
    """Groups found in more than one split; empty for a sound split."""
    per = rows.groupBy(key).agg(F.min("split").alias("_a"), F.max("split").alias("_b"))
    return per.where(F.col("_a") != F.col("_b")).select(key)


def coverage_gaps(assigned: DataFrame, seed: int = 42) -> DataFrame:
    """(species, modality, split) that an entity's modality must reach but does not."""
    need = required_splits(assigned, seed).where(F.col("modality") != "")
    wanted = need.select(*STRATUM, F.explode(F.split("required", ",")).alias("split"))
    return wanted.join(assigned.select(*STRATUM, "split").distinct(), [*STRATUM, "split"], "left_anti")


def _constants(units: DataFrame, ratios: Mapping[str, float]) -> tuple[dict, dict]:
    """Counters and quotas as driver dicts: splits x (1 + modalities + phases) numbers."""
    counts = {(r["dimension"], r["item"], r["split"]): float(r["n"]) for r in split_counters(units).collect()}
    sums: dict[tuple[str, str], float] = {}
    for (dimension, item, _), n in counts.items():
        sums[(dimension, item)] = sums.get((dimension, item), 0.0) + n
    quota = {(d, i, s): t * ratios[s] for (d, i), t in sums.items() for s in SPLITS}
    return counts, quota


def _error_expression(counts: dict, quota: dict, donor: str, receiver: str) -> Column:
    """Distribution error if this row's group moved from donor to receiver."""
    error = F.lit(0.0)
    for d, i in sorted({(d, i) for d, i, _ in quota}):
        scale = max(1.0, sum(quota[(d, i, s)] for s in SPLITS))
        weight = {"total": 1.0, "modality": MODALITY_WEIGHT, "phase": PHASE_WEIGHT}[d] / scale
        if d == "total":
            moved = F.col("size")
        elif d == "modality":
            moved = F.when(F.col("modality") == i, F.col("size")).otherwise(0)
        else:
            moved = F.coalesce(F.try_element_at("phase_counts", F.lit(i)), F.lit(0))
        for s in SPLITS:
            gap = counts.get((d, i, s), 0.0) - quota[(d, i, s)]
            change = F.lit(gap) - moved if s == donor else F.lit(gap) + moved if s == receiver else F.lit(gap)
            error = error + F.abs(change) * weight
    return error


def _current_error(counts: dict, quota: dict) -> float:
    out = 0.0
    for d, i in sorted({(d, i) for d, i, _ in quota}):
        scale = max(1.0, sum(quota[(d, i, s)] for s in SPLITS))
        weight = {"total": 1.0, "modality": MODALITY_WEIGHT, "phase": PHASE_WEIGHT}[d] / scale
        out += sum(abs(counts.get((d, i, s), 0.0) - quota[(d, i, s)]) * weight for s in SPLITS)
    return out


def _open_moves(counts: dict, quota: dict) -> list[tuple[str, str]]:
    """(donor, receiver) pairs: a split above its quota and one below it."""
    gap = {s: counts.get(("total", "", s), 0.0) - quota.get(("total", "", s), 0.0) for s in SPLITS}
    return [(a, b) for a in SPLITS for b in SPLITS if gap[a] > 0 > gap[b]]


def _helpful_moves(assigned: DataFrame, counts: dict, quota: dict, pairs: list[tuple[str, str]], seed: int) -> DataFrame:
    """Single group moves that lower the distribution error, in one column ``m`` that sorts the best first.

    ``spare_m`` and ``spare_e`` tell how many groups the donor may still give away of the stratum and of the entity.
    """
    by_stratum = presence(assigned, STRATUM).withColumnRenamed("groups", "_gm")
    by_entity = by_stratum.groupBy("species", "split").agg(F.sum("_gm").alias("_ge"))
    need = required_splits(assigned, seed)
    need_stratum = need.where(F.col("modality") != "").select(*STRATUM, F.split("required", ",").alias("_rm"))
    need_entity = need.where(F.col("modality") == "").select("species", F.split("required", ",").alias("_re"))
    guards = by_stratum.join(by_entity, ["species", "split"]).join(need_stratum, STRATUM).join(need_entity, "species")
    spare = lambda have, wanted: F.col(have) - F.array_contains(wanted, F.col("split")).cast("int")
    free = guards.select(*STRATUM, "split", spare("_gm", "_rm").alias("spare_m"), spare("_ge", "_re").alias("spare_e"))
    free = free.where("spare_m > 0 AND spare_e > 0")
    donors = sorted({a for a, _ in pairs})
    rows = assigned.where(F.col("split").isin(donors)).join(free, [*STRATUM, "split"])
    moves = F.array(
        *[
            F.when(
                F.col("split") == a,
                F.struct(
                    _error_expression(counts, quota, a, b).alias("error"),
                    F.col("size").alias("size"),
                    stable_hash(seed, F.lit(a), F.lit(b), "group_key").alias("h"),
                    F.col("group_key").alias("group_key"),
                    F.lit(a).alias("donor"),
                    F.lit(b).alias("receiver"),
                ),
            )
            for a, b in pairs
        ]
    )
    out = rows.select(F.explode(moves).alias("m"), *STRATUM, "phase_counts", "spare_m", "spare_e")
    return out.where(F.col("m").isNotNull() & (F.col("m.error") < _current_error(counts, quota)))


def best_move(assigned: DataFrame, ratios: Mapping[str, float] = DEFAULT_RATIOS, seed: int = 42) -> DataFrame:
    """At most one row: the single group move that lowers the distribution error most.

    Moves go from a split above its quota to one below it and never take the last group a required split has of an
    entity or of its modality. Ties: smaller group, then hash. The search is one pass with a plain ``min``. The groups are
    read several times and kept first: a split that is computed from the group's key would otherwise be computed for every
    sample, as filters on it go below the aggregates.
    """
    assigned = keep_table(assigned)
    counts, quota = _constants(assigned, check_ratios(ratios))
    pairs = _open_moves(counts, quota)
    if not pairs:
        return assigned.sparkSession.createDataFrame([], "group_key string, donor string, receiver string, size bigint, error double")
    best = _helpful_moves(assigned, counts, quota, pairs, seed).agg(F.min("m").alias("m")).where(F.col("m").isNotNull())
    return best.select("m.group_key", "m.donor", "m.receiver", "m.size", "m.error")


def _accept(candidates: list, counts: dict, quota: dict) -> dict[str, str]:
    """Go through the candidates in order and keep those that still lower the error; updates ``counts``."""
    current = _current_error(counts, quota)
    moved: dict[str, str] = {}
    taken: dict[tuple, int] = {}
    for c in candidates:
        donor, receiver, key = c["m"]["donor"], c["m"]["receiver"], c["m"]["group_key"]
        stratum, entity = (c["species"], c["modality"], donor), (c["species"], donor)
        if key in moved or (donor, receiver) not in _open_moves(counts, quota):
            continue
        if taken.get(stratum, 0) >= c["spare_m"] or taken.get(entity, 0) >= c["spare_e"]:
            continue
        parts = {("total", ""): c["m"]["size"], ("modality", c["modality"]): c["m"]["size"]}
        parts |= {("phase", p): n for p, n in (c["phase_counts"] or {}).items()}
        after = dict(counts)
        for (d, i), n in parts.items():
            after[(d, i, donor)] = after.get((d, i, donor), 0.0) - n
            after[(d, i, receiver)] = after.get((d, i, receiver), 0.0) + n
        error = _current_error(after, quota)
        # A gain within rounding could be undone by the next pass for ever.
        if error < current - LEAST_GAIN:
            counts.update(after)
            current = error
            moved[key] = receiver
            for place in (stratum, entity):
                taken[place] = taken.get(place, 0) + 1
    return moved


def _stay_hash(seed: int) -> Column:
    return stable_hash(seed, F.lit("stay"), "group_key")


def _movable(assigned: DataFrame, seed: int) -> DataFrame:
    """Groups that can leave their split whatever else leaves it: where a split must be reached, one group stays behind
    of the stratum and one of the entity, the last by hash. ``_stay`` is the leading part of that hash: a number, so that
    one hashed aggregate finds the few groups that may be last."""
    need = required_splits(assigned, seed)
    most = assigned.groupBy(*STRATUM, "split").agg(F.max("_stay").alias("_stay"))
    near = assigned.select("group_key", *STRATUM, "split", "_stay").join(small_side(most), [*STRATUM, "split", "_stay"])
    last = F.max(F.struct(_stay_hash(seed).alias("_h"), F.col("group_key"))).alias("_last")
    per_stratum = cut_lineage(near.groupBy(*STRATUM, "split").agg(last))
    per_entity = per_stratum.groupBy("species", "split").agg(F.max("_last").alias("_last"))
    wanted = lambda rows: rows.select(*STRATUM, F.explode(F.split("required", ",")).alias("split"))
    stays = per_stratum.join(wanted(need.where("modality <> ''")), [*STRATUM, "split"]).select("_last.group_key")
    stays = stays.unionByName(per_entity.join(wanted(need.where("modality = ''")).drop("modality"), ["species", "split"]).select("_last.group_key"))
    return assigned.join(small_side(cut_lineage(stays.distinct())), "group_key", "left_anti")


CLASS = ["split", "modality", "size", "_mix"]


def _helpful_classes(movable: DataFrame, counts: dict, quota: dict, pairs: list[tuple[str, str]], limit: int) -> list:
    """Classes of groups that look alike to the error (split, modality, size, samples per phase), best first."""
    classes = movable.where(F.col("split").isin(sorted({a for a, _ in pairs}))).groupBy(*CLASS).agg(F.count(F.lit(1)).alias("n"))
    classes = classes.withColumn("phase_counts", F.map_from_entries("_mix"))
    errors = [F.when(F.col("split") == a, _error_expression(counts, quota, a, b)) for a, b in pairs]
    best = classes.withColumn("_e", F.array_min(F.array(*errors))).where(F.col("_e") < _current_error(counts, quota) - LEAST_GAIN)
    return best.orderBy("_e", *CLASS).limit(limit).select(*CLASS, "n").collect()


def exchange(classes: Sequence, counts: dict, quota: dict) -> list[tuple[int, str, int]]:
    """Moves (class, receiver, groups) that bring the splits to their quotas; updates ``counts``.

    Each step takes the class and receiver whose single group lowers the error most (ties: smaller size, then order). As
    long as no count is within one group of its quota, all gains stay as they are, so that many groups go in one step.
    Ends when no single group helps.
    """
    dims = sorted({(d, i) for d, i, _ in quota})
    place = {dim: k for k, dim in enumerate(dims)}
    weights = np.array([{"total": 1.0, "modality": MODALITY_WEIGHT, "phase": PHASE_WEIGHT}[d] / max(1.0, sum(quota[(d, i, s)] for s in SPLITS)) for d, i in dims])
    gaps = {s: np.array([counts.get((*dim, s), 0.0) - quota[(*dim, s)] for dim in dims]) for s in SPLITS}
    total = place[("total", "")] if dims else 0
    vectors = np.zeros((len(classes), len(dims)))
    for k, c in enumerate(classes):
        vectors[k, [total, place[("modality", c["modality"])]]] = c["size"]
        for phase, n in c["_mix"]:
            vectors[k, place[("phase", phase)]] = n
    largest = vectors.max(axis=0, initial=0)
    left = np.array([c["n"] for c in classes])
    home = np.array([c["split"] for c in classes])
    sizes = np.array([c["size"] for c in classes])
    moves: dict[tuple[int, str], int] = {}

    def change(donor: str, receiver: str, moved: np.ndarray) -> np.ndarray:
        a, b = gaps[donor], gaps[receiver]
        return (np.abs(a - moved) - np.abs(a) + np.abs(b + moved) - np.abs(b)) @ weights

    while True:
        found = []
        for donor in SPLITS:
            at = np.flatnonzero((home == donor) & (left > 0)) if len(home) and gaps[donor][total] > 0 else []
            for receiver in SPLITS if len(at) else ():
                if gaps[receiver][total] < 0:
                    gain = change(donor, receiver, vectors[at])
                    first = np.lexsort((at, sizes[at], np.round(gain, 12)))[0]
                    found.append((round(float(gain[first]), 12), int(sizes[at[first]]), int(at[first]), donor, receiver))
        if not found or min(found)[0] >= -LEAST_GAIN:
            break
        _, size, k, donor, receiver = min(found)
        own = vectors[k] > 0
        room = np.concatenate([gaps[donor][own], -gaps[receiver][own]])
        spare = (room - np.tile(largest[own], 2)) / np.tile(vectors[k][own], 2)
        # Counts beyond their quota move further away from it and meet no bend.
        n = int(min(left[k], max(1, math.floor(spare[room > 0].min(initial=math.inf)) if (room > 0).any() else 1)))
        gaps[donor] = gaps[donor] - n * vectors[k]
        gaps[receiver] = gaps[receiver] + n * vectors[k]
        left[k] -= n
        moves[k, receiver] = moves.get((k, receiver), 0) + n
    for s in SPLITS:
        counts.update({(*dim, s): float(gaps[s][k] + quota[(*dim, s)]) for k, dim in enumerate(dims)})
    return [(k, receiver, n) for (k, receiver), n in moves.items()]


def _apply_moves(assigned: DataFrame, movable: DataFrame, classes: Sequence, moves: list[tuple[int, str, int]], seed: int) -> DataFrame:
    """Each move takes the next groups of its class by hash: a rank range per move, applied by one join."""
    spark = assigned.sparkSession
    taken: dict[int, int] = {}
    cuts = []
    for k, receiver, n in moves:
        start = taken.get(k, 0)
        taken[k] = start + n
        c = classes[k]
        cuts.append((c["split"], c["modality"], c["size"], [(p, v) for p, v in c["_mix"]], start, start + n, receiver))
    schema = "split string, modality string, size long, _mix array<struct<key:string,value:bigint>>, _from long, _upto long, _to string"
    ranges = F.broadcast(spark.createDataFrame(cuts, schema))  # at most a few rows per collected class
    rows = movable.select("group_key", *CLASS).join(F.broadcast(ranges.select(*CLASS).distinct()), CLASS)
    ranked = row_numbers(rows.withColumn("_h", stable_hash(seed, F.lit("move"), "group_key")), CLASS, ["_h", "group_key"], "_r", bucket=hex_prefix(F.col("_h"), 2))
    going = cut_lineage(ranked.join(ranges, CLASS).where("_r > _from AND _r <= _upto").select("group_key", "_to"))
    return assigned.join(small_side(going), "group_key", "left").withColumn("split", F.coalesce("_to", "split")).select(*assigned.columns)


def rebalance(assigned: DataFrame, ratios: Mapping[str, float] = DEFAULT_RATIOS, seed: int = 42, per_pass: int = 10_000) -> DataFrame:
    """Move groups until no single move lowers the distribution error.

    Groups that look alike to the error are one class with a number. A pass brings the classes whose moves help
    (``CLASSES_PER_PASS`` at most) to the driver, where ``exchange`` decides how many groups of each go where; the numbers
    go back as rank ranges, so that no groups travel. What is left then are moves that the rule of staying groups forbade
    though another group of their stratum stays; passes over single groups take those, ``per_pass`` at a time. Every
    move lowers the error, so passes end. The result of each pass is kept on shared storage.
    """
    ratios = check_ratios(ratios)
    stay = F.conv(F.substring(_stay_hash(seed), 1, 15), 16, 10).cast("bigint")
    current = keep_table(_with_mix(assigned).withColumn("_stay", stay))
    while True:
        counts, quota = _constants(current, ratios)
        pairs = _open_moves(counts, quota)
        if not pairs:
            return current.select(*assigned.columns)
        movable = _movable(current, seed)
        classes = _helpful_classes(movable, counts, quota, pairs, CLASSES_PER_PASS)
        moves = exchange(classes, counts, quota)
        if moves:
            current = keep_table(_apply_moves(current, movable, classes, moves, seed))
            continue
        candidates = _helpful_moves(current, counts, quota, pairs, seed).orderBy("m").limit(per_pass).collect()
        moved = _accept(candidates, counts, quota)
        if not moved:
            return current.select(*assigned.columns)
        single = current.sparkSession.createDataFrame(list(moved.items()), "group_key string, _to string")
        joined = current.join(F.broadcast(single), "group_key", "left")
        current = keep_table(joined.withColumn("split", F.coalesce("_to", "split")).select(*current.columns))


def repaired_split(units: DataFrame, ratios: Mapping[str, float] = DEFAULT_RATIOS, seed: int = 42) -> DataFrame:
    """The split that is written: groups assigned by quota, then moved until no single move helps."""
    return rebalance(grouped_split(units, ratios, seed), ratios, seed)


def balance_stats(rows: DataFrame) -> DataFrame:
    """Per split: entities present and the least, most, mean and median samples per entity."""
    return _balance(rows.groupBy("split", "species").agg(F.count(F.lit(1)).alias("n")))


def _balance(per: DataFrame) -> DataFrame:
    return per.groupBy("split").agg(
        F.count(F.lit(1)).alias("present_species_count"),
        F.min("n").alias("min_samples_per_species"),
        F.max("n").alias("max_samples_per_species"),
        F.bround(F.avg("n"), 4).alias("mean_samples_per_species"),
        F.bround(F.median("n"), 4).alias("median_samples_per_species"),
    )


def class_counts(rows: DataFrame, protocol: str, entities: DataFrame | None = None) -> DataFrame:
    """Per (split, entity), zero-filled: samples, distinct raw specimens, modality and phase counts.

    Specimens are counted by their raw id, without blanking NA-like texts and across modalities.
    """
    ident = F.coalesce(non_blank("specimen_id"), non_blank("source_id"), F.col("image_path"))
    macro, micro = F.col("modality") == "macro", F.col("modality") == "micro"
    # Rows are counted with a hashed aggregate first; the text maximum, which needs a sort, then sees one row per specimen.
    figures = {"total_samples": F.count(F.lit(1)), "macro_samples": F.count_if(macro), "micro_samples": F.count_if(micro)}
    figures |= {f"{p.lower()}_macro_samples": F.count_if(macro & (F.col("phase") == p)) for p in PHASES}
    counted = rows.groupBy("split", "species", "protocol_group", ident.alias("_ident")).agg(*[n.alias(c) for c, n in figures.items()])
    total = lambda c: F.sum(c).alias(c)
    counts = counted.groupBy("split", "species").agg(
        total("total_samples"), F.count_distinct("_ident").alias("groups_in_split"), F.max("protocol_group").alias("_group"), *[total(c) for c in figures if c != "total_samples"]
    )
    names = [c for c in counts.columns if c not in ("split", "species", "_group")]
    # At most one entry per split and entity: a lookup list of three, not a join, fills the gaps with zeros.
    packed = counts.groupBy("species").agg(F.max("_group").alias("protocol_group"), F.collect_list(F.struct("split", *names)).alias("_c"))
    if entities is not None:
        packed = entities.select("species").distinct().join(packed, "species", "left").na.fill("")
    found = lambda s: F.get(F.filter("_c", lambda x: x["split"] == s), F.lit(0))
    filled = F.array(*[F.struct(F.lit(s).alias("split"), *[F.coalesce(found(s)[c], F.lit(0)).alias(c) for c in names]) for s in SPLITS])
    out = packed.select("species", "protocol_group", F.explode(filled).alias("x")).select("species", "protocol_group", "x.*")
    out = out.withColumn("protocol", F.lit(protocol))
    return out.withColumn("present_in_split", (F.col("total_samples") > 0).cast("int")).select(*CLASS_COUNT_COLUMNS)


def split_summary(rows: DataFrame, ratios: Mapping[str, float] = DEFAULT_RATIOS) -> DataFrame:
    """Per split: samples, target, ratio, modality and phase counts, entities, groups and balance figures."""
    phases = [F.count_if(F.col("phase") == p).alias(p) for p in PHASES]
    return group_summary(keep_table(rows.groupBy("split", "group_key", *STRATUM).agg(F.count(F.lit(1)).alias("size"), *phases)), ratios)


def group_summary(groups: DataFrame, ratios: Mapping[str, float] = DEFAULT_RATIOS) -> DataFrame:
    """``split_summary`` from counted groups (``group_sizes`` with a split): every sample is in one group, so that the samples
    need not be read again."""
    ratios = check_ratios(ratios)
    of = lambda m, c: F.sum(F.when(F.col("modality") == m, F.col(c)).otherwise(0))
    small = groups.groupBy("split", "group_key").agg(
        F.sum("size").alias("n"), *[of(m, "size").alias(m) for m in MODALITIES], *[of("macro", p).alias(p) for p in PHASES]
    )
    per = small.groupBy("split").agg(
        F.sum("n").alias("sample_count"),
        F.count(F.lit(1)).alias("group_count"),
        *[F.sum(m).alias(f"{m}_samples") for m in MODALITIES],
        *[F.sum(p).alias(f"{p.lower()}_macro_samples") for p in PHASES],
    )
    per = cut_lineage(per)  # one row a split
    total = float(per.agg(F.sum("sample_count")).first()[0] or 0)
    ratio = F.col("split")
    share = F.when(ratio == "train", ratios["train"]).when(ratio == "val", ratios["val"]).otherwise(ratios["test"])
    out = per.join(_balance(groups.groupBy("split", "species").agg(F.sum("size").alias("n"))), "split")
    return out.withColumns(
        {
            "target_sample_count": F.bround(F.lit(total) * share, 4),
            "actual_ratio": F.bround(F.col("sample_count") / F.lit(max(total, 1.0)), 6),
        }
    )


def split_totals(rows: DataFrame, protocol: str, seed: int = 42, ratios: Mapping[str, float] = DEFAULT_RATIOS) -> DataFrame:
    """One row for the whole protocol: seed, ratios, samples, groups and entities."""
    ratios = check_ratios(ratios)
    groups = rows.groupBy("species", "group_key").agg(F.count(F.lit(1)).alias("n"))
    per_entity = groups.groupBy("species").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"))
    out = per_entity.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_samples"), F.coalesce(F.sum("groups"), F.lit(0)).alias("group_count"), F.count(F.lit(1)).alias("species_count")
    )
    return out.select(F.lit(protocol).alias("protocol"), F.lit(seed).alias("seed"), *[F.lit(ratios[s]).alias(f"{s}_ratio") for s in SPLITS], *out.columns)


def ratio_deviations(rows: DataFrame, ratios: Mapping[str, float] = DEFAULT_RATIOS) -> DataFrame:
    """Splits whose share of the samples is off by more than the tolerance: wanted and actual ratio, their difference,
    wanted and actual samples."""
    ratios = check_ratios(ratios)
    found = {r["split"]: r["n"] for r in rows.groupBy("split").agg(F.count(F.lit(1)).alias("n")).where(F.col("split").isin(list(SPLITS))).collect()}
    total = sum(found.values())
    out = []
    for s in SPLITS:
        actual = found.get(s, 0) / total if total else 0.0
        if abs(actual - ratios[s]) > RATIO_TOLERANCE:
            out.append((s, round(ratios[s], 6), round(actual, 6), round(actual - ratios[s], 6), round(total * ratios[s], 4), found.get(s, 0)))
    return rows.sparkSession.createDataFrame(out, "split string, target_ratio double, actual_ratio double, delta_ratio double, target_samples double, actual_samples long")


def split_warnings(rows: DataFrame, ratios: Mapping[str, float] = DEFAULT_RATIOS) -> DataFrame:
    """(kind, item): ratio deviations, splits without a modality, thin entities, entities lost after train."""
    ratios = check_ratios(ratios)
    small = rows.groupBy("split", "species", "group_key").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("modality") == m).alias(m) for m in MODALITIES]
    )
    per_entity = small.groupBy("species").agg(
        F.sum("n").alias("n"),
        F.count_distinct("group_key").alias("groups"),
        *[F.max((F.col("split") == s).cast("int")).alias(s) for s in SPLITS],
    )
    floor_samples = max(math.ceil(1 / ratios["val"]), math.ceil(1 / ratios["test"]))
    lost = lambda s: (F.col("train") == 1) & (F.col(s) == 0)
    checks = [
        ("too_few_groups", F.col("groups") < len(SPLITS)),
        ("too_few_samples", F.col("n") < floor_samples),
        ("missing_from_val", lost("val")),
        ("missing_from_test", lost("test")),
    ]
    flagged = per_entity.select("species", F.explode(F.array(*[F.when(c, F.lit(k)) for k, c in checks])).alias("kind"))
    entity_rows = flagged.where(F.col("kind").isNotNull()).select("kind", F.col("species").alias("item"))
    per_split = small.groupBy("split").agg(F.sum("n").alias("n"), *[F.sum(m).alias(m) for m in MODALITIES])
    found = {r["split"]: r for r in per_split.collect()}
    total = sum(r["n"] for r in found.values())
    rows_out = []
    for s in SPLITS:
        actual = (found[s]["n"] if s in found else 0) / total if total else 0.0
        if abs(actual - ratios[s]) > RATIO_TOLERANCE:
            rows_out.append(("ratio", s))
        rows_out += [("modality", f"{s} has no {m} samples.") for m in MODALITIES if s not in found or not found[s][m]]
    fixed = rows.sparkSession.createDataFrame(rows_out, "kind string, item string")
    return entity_rows.unionByName(fixed)
