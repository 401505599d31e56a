"""Batch plans on thin pools, uneven weights and small populations."""

import hashlib
import os
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from benchweave.operators import batches


def numbers(spark, n):
    return spark.range(n).withColumnRenamed("id", "batch_id")


def test_picks_end_with_weights_over_six_decades(spark):
    entities = spark.createDataFrame([(f"s{i}", 10.0 ** -i) for i in range(7)], "species string, weight double")
    got = batches.pick_entities(numbers(spark, 50), entities, 7).collect()
    per = defaultdict(dict)
    for r in got:
        per[r["batch_id"]][r["place"]] = r["species"]
    assert len(per) == 50
    assert all(sorted(p) == list(range(1, 8)) and len(set(p.values())) == 7 for p in per.values())


def test_picks_follow_the_weights_also_beyond_the_first_draws(spark):
    entities = spark.createDataFrame([("a", 1.0), ("b", 1e-5), ("c", 3e-5)], "species string, weight double")
    got = batches.pick_entities(numbers(spark, 3000), entities, 2).where("place = 2").groupBy("species").count().collect()
    n = {r["species"]: r["count"] for r in got}
    assert sum(n.values()) == 3000 and abs(n["c"] / 3000 - 0.75) < 0.05


def test_intervals_cover_the_whole_line(spark):
    entities = spark.createDataFrame([(f"s{i:03d}", (i + 1) ** -0.5) for i in range(300)], "species string, weight double").withColumn("_all", F.lit(0))
    rows = batches._intervals(entities, ["_all"], 64).select("species", "_lo", "_up").distinct().orderBy("_lo").collect()
    assert rows[0]["_lo"] == 0.0 and rows[-1]["_up"] == 1.0
    assert all(a["_up"] == b["_lo"] for a, b in zip(rows, rows[1:]))


def test_fresh_entities_while_any_exist(spark):
    counts = {"s0": 4000, "s1": 2000, "s2": 40, "s3": 9, "s4": 3, "s5": 2, "s6": 1}
    rows = [(f"{s}_{m}_{i}", s, m) for s, n in counts.items() for m in ("macro", "micro") for i in range(n)]
    samples = spark.createDataFrame(rows, "id string, species string, modality string")
    plan = batches.plan_batches(samples, 16, classes=7, pairs=2, power=3.0, drop_last=True).where("batch_id < 40")
    per = plan.groupBy("batch_id").agg(F.count_distinct("species").alias("n"), F.count(F.lit(1)).alias("size")).collect()
    assert {(r["n"], r["size"]) for r in per} == {(7, 16)}


@pytest.mark.parametrize("drop_last", [False, True])
def test_thin_pool_is_filled_from_the_other_modality(spark, drop_last):
    rows = [(f"a{i}", "s1", "macro") for i in range(30)] + [("b0", "s1", "micro"), ("b1", "s2", "micro")]
    samples = spark.createDataFrame(rows, "id string, species string, modality string")
    plan = batches.plan_batches(samples, 8, drop_last=drop_last).collect()
    per = defaultdict(list)
    for r in plan:
        per[r["batch_id"]].append(r)
    assert len(per) == 4
    for batch in per.values():
        assert len({r["id"] for r in batch}) == 8 and sorted(r["slot"] for r in batch) == list(range(8))


def test_fewer_items_than_slots(spark):
    samples = spark.createDataFrame([("a", "s", "macro"), ("b", "s", "macro"), ("c", "t", "macro")], "id string, species string, modality string")
    plan = batches.plan_batches(samples, 5).collect()
    assert Counter(r["id"] for r in plan) == {"a": 1, "b": 1, "c": 1}
    assert batches.plan_batches(samples, 5, drop_last=True).count() == 0


def test_draws_are_never_the_broadcast_side(spark):
    """Draws are exploded batches, which the planner takes for one row a batch."""
    entities = spark.createDataFrame([(f"s{i}", 1.0 / (i + 1)) for i in range(20)], "species string, weight double")
    draws = numbers(spark, 10_000).select("batch_id", F.explode(F.sequence(F.lit(0), F.lit(500))).alias("j")).withColumn("u", F.rand(1)).withColumn("_all", F.lit(0))
    intervals = batches._intervals(entities.withColumn("_all", F.lit(0)), ["_all"], 64)
    plan = batches._resolve(draws, intervals, ["_all"], 64)._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert len(joins) == 1 and "BuildRight" in joins[0]


def catalogue_items(spark, n):
    """Items of 25 species, three in four of them macro; ids as long as those of the registered query."""
    name = F.concat_ws("-", F.col("id"), F.col("id") % 7, F.col("id") * 31 % 20_011, F.lit("1996-09-13"))
    kind = F.when(F.col("id") % 4 == 0, "micro").otherwise("macro")
    return spark.range(n).select(name.alias("id"), F.concat(F.lit("Species s"), F.col("id") % 25).alias("species"), kind.alias("modality"))


def test_items_follow_the_hash_order_of_their_pool(spark, monkeypatch):
    """Blocks of few items give each pool's items in hash order, round after round."""
    samples = catalogue_items(spark, 3000)
    whole = sorted(map(tuple, batches.plan_batches(samples, 16, seed=3).collect()))
    monkeypatch.setattr(batches, "POOL_BLOCK", 7)
    plan = sorted(map(tuple, batches.plan_batches(samples, 16, seed=3).collect()))
    assert plan == whole and len(plan) == 3008
    mark = lambda s, m, c, i: hashlib.sha256(f"3|{s}|{m}|{c}|{i}".encode()).hexdigest()[:16]
    pools, drawn = defaultdict(list), defaultdict(list)
    for r in samples.collect():
        pools[r["species"], r["modality"]].append(r["id"])
    for _, _, _, i, s, m in plan:
        drawn[s, m].append(i)
    rounds = 0
    for (s, m), got in drawn.items():
        n = len(pools[s, m])
        rounds = max(rounds, -(-len(got) // n))
        order = [i for c in range(-(-len(got) // n)) for i in sorted(pools[s, m], key=lambda i: mark(s, m, c, i))]
        assert got == order[: len(got)]
    assert rounds > 1


def test_plan_keeps_little_on_shared_storage(spark):
    """Items, picks and rows are kept compressed; picks and the whole plan were checkpointed row by row."""
    from benchweave.session import ensure_checkpoint_dir

    top = ensure_checkpoint_dir(spark).removeprefix("file:")
    size = lambda: sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(top) for f in names)
    samples, before = catalogue_items(spark, 60_000), size()
    plan = batches.plan_batches(samples, 128, classes=24, pairs=12)
    assert size() - before < 40 * 60_000
    assert plan.count() == 469 * 128 and "ExistingRDD" not in plan._jdf.queryExecution().executedPlan().toString()
