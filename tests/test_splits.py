import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from benchweave.operators import batches, splits

SCHEMA = "group_key string, species string, modality string, protocol_group string, size bigint, phase_counts map<string,bigint>"


def units(spark, rows):
    return spark.createDataFrame([(k, s, m, "A", n, {"Phase1": n} if m == "macro" else {}) for k, s, m, n in rows], SCHEMA)


def test_ratios():
    for bad in ({"train": 0.5, "val": 0.5, "test": 0.5}, {"train": 1.0, "val": 0.0, "test": 0.0}, {"train": 1.0}):
        with pytest.raises(ValueError):
            splits.check_ratios(bad)


def test_thin_entities(spark):
    rows = [("a", "one", "macro", 3), ("b", "two", "macro", 5), ("c", "two", "macro", 5), ("d", "both", "macro", 2), ("e", "both", "macro", 1), ("f", "both", "micro", 2), ("g", "both", "micro", 1)]
    rows += [(f"t{i}", "three", "micro", 4) for i in range(3)]
    out = {r["group_key"]: r["split"] for r in splits.grouped_split(units(spark, rows)).collect()}
    assert len(out) == len(rows) and out["a"] == "train"
    assert sorted([out["b"], out["c"]])[0] in ("test", "train") and "train" in (out["b"], out["c"]) and out["b"] != out["c"]
    assert out["d"] == out["f"] == "train" and {out["e"], out["g"]} == {"val", "test"}  # opposite hold-outs
    assert {out[f"t{i}"] for i in range(3)} == {"train", "val", "test"}
    need = {(r["species"], r["modality"]): r["required"] for r in splits.required_splits(units(spark, rows)).collect()}
    assert need[("one", "")] == "train" and need[("three", "micro")] == "train,val,test" and need[("both", "")] == "train,val,test"


def random_units(n=400, seed=1, hot=0.4):
    rng = random.Random(seed)
    return [(f"g{i}", "hot" if rng.random() < hot else f"s{rng.randrange(6)}", rng.choice(["macro", "micro"]), rng.randrange(1, 30)) for i in range(n)]


def test_split_ignores_order_and_partitioning(spark):
    rows = random_units()
    first = splits.grouped_split(units(spark, rows)).select("group_key", "split")
    random.Random(9).shuffle(rows)
    second = splits.grouped_split(units(spark, rows).repartition(3)).select("group_key", "split")
    assert sorted(first.collect()) == sorted(second.collect())
    done = splits.grouped_split(units(spark, rows))
    assert splits.leaks(done).isEmpty() and splits.coverage_gaps(done).isEmpty()


def brute_split(rows, ratios, seed=42):
    """The rules over whole strata: seeds, then the rest by hash against the quotas."""
    digest = lambda *parts: hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:16]
    strata, out = defaultdict(list), {}
    for key, species, modality, size in rows:
        strata[species, modality].append((size, digest(seed, key), key))
    for (species, modality), groups in strata.items():
        val_first = int(digest(seed, species, "holdout")[15], 16) < 8
        top = min(groups, key=lambda g: (-g[0], g[1], g[2]))
        low = sorted(g for g in groups if g != top)
        first = "val" if val_first != (len(groups) == 2 and modality == "micro") else "test"
        out |= dict(zip([g[2] for g in (top, *low[:2])], ["train", first, "test" if val_first else "val"]))
        upto, left = 0, sum(g[0] for g in low[2:])
        for size, _, key in sorted(low[2:], key=lambda g: g[1:]):
            upto += size
            middle = (upto - size / 2.0) / max(left, 1)
            out[key] = "train" if middle < ratios["train"] else "val" if middle < ratios["train"] + ratios["val"] else "test"
    return out


@pytest.mark.parametrize("digits", [1, 3])
def test_cuts_equal_brute_force(spark, monkeypatch, digits):
    """Samples get the split of their group without meeting the groups: one small table of places per stratum."""
    monkeypatch.setattr(splits, "CUT_DIGITS", digits)
    rows = random_units(1500, 11) + [("alone", "one", "macro", 2), ("pair a", "two", "micro", 3), ("pair b", "two", "micro", 3)]
    ratios = {"train": 0.6, "val": 0.25, "test": 0.15}
    want = brute_split(rows, ratios)
    got = splits.grouped_split(units(spark, rows), ratios).collect()
    assert {r["group_key"]: r["split"] for r in got} == want and len(got) == len(rows)
    cuts = splits.quota_cuts(units(spark, rows), ratios)
    samples = units(spark, rows).selectExpr("group_key", "species", "modality", "explode(sequence(1, int(size))) AS item")
    done = splits.split_by_cuts(samples, cuts)
    counted = {(r["group_key"], r["split"]): r["count"] for r in done.groupBy("group_key", "split").count().collect()}
    assert counted == {(k, want[k]): n for k, _, _, n in rows}
    done.collect()
    assert "hashpartitioning" not in done._jdf.queryExecution().executedPlan().toString()


def brute_error(rows, where, ratios):
    total = 0.0
    dims = [(1.0, lambda r: [("all", r[3])]), (0.35, lambda r: [(r[2], r[3])]), (0.2, lambda r: [("Phase1", r[3])] if r[2] == "macro" else [])]
    for weight, of in dims:
        have, sums = defaultdict(Counter), Counter()
        for r in rows:
            for item, n in of(r):
                have[item][where[r[0]]] += n
                sums[item] += n
        for item, n in sums.items():
            total += weight * sum(abs(have[item][s] - n * ratios[s]) for s in ratios) / max(1.0, n)
    return total


def test_best_move_equals_brute_force(spark):
    rows = random_units(120, 4)
    ratios = splits.DEFAULT_RATIOS
    where = {r[0]: ["train", "val", "test"][i % 3] for i, r in enumerate(rows)}
    assigned = units(spark, rows).join(spark.createDataFrame(list(where.items()), "group_key string, split string"), "group_key")
    move = splits.best_move(assigned).first()
    base = brute_error(rows, where, ratios)
    n = sum(r[3] for r in rows)
    size = Counter()
    for r in rows:
        size[where[r[0]]] += r[3]
    entity, stratum = Counter((r[1], where[r[0]]) for r in rows), Counter((r[1], r[2], where[r[0]]) for r in rows)
    best = base
    for r in rows:
        a = where[r[0]]
        for b in ratios:
            if a == b or size[a] <= n * ratios[a] or size[b] >= n * ratios[b] or entity[(r[1], a)] <= 1 or stratum[(r[1], r[2], a)] <= 1:
                continue
            best = min(best, brute_error(rows, {**where, r[0]: b}, ratios))
    assert move is not None and abs(move["error"] - best) < 1e-9 and best < base
    assert abs(splits.distribution_error(splits.split_counters(assigned), splits.targets(assigned)).first()[0] - base) < 1e-9
    fixed = splits.rebalance(assigned)
    assert splits.best_move(fixed).isEmpty() and splits.best_move(splits.rebalance(assigned, per_pass=9)).isEmpty()
    assert fixed.columns == assigned.columns and fixed.count() == len(rows)
    after = {r["group_key"]: r["split"] for r in fixed.collect()}
    assert brute_error(rows, after, ratios) < best
    # The thirds above need not cover everything; moves must not open a new gap.
    assert set(splits.coverage_gaps(fixed).collect()) <= set(splits.coverage_gaps(assigned).collect())


def counted_rows(df):
    """``df`` and the number of its rows that were computed so far."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def look(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(look, df.schema), seen


def test_groups_and_samples_are_read_once(spark):
    rows = random_units(120, 4)
    assigned = units(spark, rows).withColumn("split", F.when(F.col("group_key") < "g5", "train").otherwise("val"))
    watched, seen = counted_rows(assigned)
    assert splits.best_move(watched).count() == 1 and seen.value == len(rows)
    samples = assigned.selectExpr("split", "group_key", "species", "modality", "explode(sequence(1, int(size))) AS item", "if(modality = 'macro', 'Phase1', '') AS phase")
    watched, seen = counted_rows(samples)
    got = {r["split"]: r for r in splits.split_summary(watched).collect()}
    total = sum(r[3] for r in rows)
    assert seen.value == total and sum(r["sample_count"] for r in got.values()) == total
    assert got["train"]["group_count"] == sum(r[0] < "g5" for r in rows)
    assert got["val"]["phase1_macro_samples"] == sum(r[3] for r in rows if r[0] >= "g5" and r[2] == "macro")


def test_exchange_moves_many_at_once():
    """Two classes, one far above its quota: few steps, and no single group helps afterwards."""
    ratios = {"train": 0.5, "val": 0.25, "test": 0.25}
    classes = [
        {"split": "train", "modality": "macro", "size": 3, "_mix": [("Phase1", 3)], "n": 1000},
        {"split": "train", "modality": "micro", "size": 1, "_mix": [], "n": 500},
        {"split": "val", "modality": "macro", "size": 2, "_mix": [("Phase1", 1)], "n": 7},
    ]
    counts = {}
    for c in classes:
        for d, i, n in [("total", "", c["size"]), ("modality", c["modality"], c["size"]), *(("phase", p, n) for p, n in c["_mix"])]:
            for s in ratios:
                counts[d, i, s] = counts.get((d, i, s), 0.0) + (n * c["n"] if s == c["split"] else 0)
    sums = Counter()
    for (d, i, _), n in counts.items():
        sums[d, i] += n
    quota = {(d, i, s): n * ratios[s] for (d, i), n in sums.items() for s in ratios}
    before = splits._current_error(counts, quota)
    moves = splits.exchange(classes, counts, quota)
    after = splits._current_error(counts, quota)
    assert after < 0.02 < before and 2 <= len(moves) <= 12
    left = Counter({k: c["n"] for k, c in enumerate(classes)})
    for k, _, n in moves:
        left[k] -= n
    assert min(left.values()) >= 0
    assert not splits.exchange([{**c, "n": left[k]} for k, c in enumerate(classes)], counts, quota)


@pytest.mark.parametrize("limit", [20_000, 2])
def test_repaired_split(spark, monkeypatch, limit):
    """Repair of the split that is written: no move left that helps, no gap opened, no leak, most groups where they were."""
    monkeypatch.setattr(splits, "CLASSES_PER_PASS", limit)
    rows = random_units(300, 6, hot=0.35)
    ratios = {"train": 0.6, "val": 0.25, "test": 0.15}
    first = splits.grouped_split(units(spark, rows), ratios)
    done = splits.repaired_split(units(spark, rows), ratios)
    before, after = ({r["group_key"]: r["split"] for r in df.collect()} for df in (first, done))
    assert set(after) == set(before) and done.columns == first.columns
    assert brute_error(rows, after, ratios) < brute_error(rows, before, ratios)
    assert splits.best_move(done, ratios).isEmpty() and splits.leaks(done).isEmpty()
    assert set(splits.coverage_gaps(done).collect()) <= set(splits.coverage_gaps(first).collect())
    assert sum(after[k] != before[k] for k in after) < len(rows) / 4
    again = splits.repaired_split(units(spark, rows).repartition(3), ratios)
    assert {r["group_key"]: r["split"] for r in again.collect()} == after


def test_class_counts_and_warnings(spark):
    rows = [("p1", "S", "g1", "macro", "Phase1", "train", "NA"), ("p2", "S", "g2", "micro", "", "train", "NA"), ("p3", "T", "g3", "macro", "Phase2", "test", "t")]
    df = spark.createDataFrame(rows, "image_path string, species string, group_key string, modality string, phase string, split string, specimen_id string")
    df = df.withColumn("source_id", F.lit("")).withColumn("protocol_group", F.lit("A"))
    got = {(r["split"], r["species"]): r for r in splits.class_counts(df, "P1").collect()}
    assert len(got) == 6
    assert got[("train", "S")]["groups_in_split"] == 1  # the raw id counts, NA and modality ignored
    assert got[("test", "T")]["phase2_macro_samples"] == 1 and got[("val", "S")]["present_in_split"] == 0
    kinds = Counter(r["kind"] for r in splits.split_warnings(df).collect())
    assert kinds["missing_from_val"] == 1 and kinds["too_few_samples"] == 2 and kinds["modality"] == 3


def test_totals_and_deviations(spark):
    rows = [("S", "g1", "train")] * 8 + [("S", "g2", "val")] + [("T", "g3", "train")]
    df = spark.createDataFrame(rows, "species string, group_key string, split string")
    total = splits.split_totals(df, "P1", 7).first()
    assert (total["protocol"], total["seed"], total["total_samples"], total["group_count"], total["species_count"]) == ("P1", 7, 10, 3, 2)
    got = {r["split"]: tuple(r)[1:] for r in splits.ratio_deviations(df).collect()}
    assert got == {"train": (0.7, 0.9, 0.2, 7.0, 9), "val": (0.15, 0.1, -0.05, 1.5, 1), "test": (0.15, 0.0, -0.15, 1.5, 0)}
    assert splits.ratio_deviations(df.where("false")).count() == 3 and splits.split_totals(df.where("false"), "P1").first()["total_samples"] == 0


def test_batch_plan_rules(spark):
    rng = random.Random(5)
    rows = [(f"i{i}", "hot" if rng.random() < 0.35 else f"s{rng.randrange(12)}", "macro" if rng.random() < 0.8 else "micro") for i in range(1500)]
    samples = spark.createDataFrame(rows, "id string, species string, modality string")
    plan = batches.plan_batches(samples, 32, classes=10, pairs=6, seed=7).collect()
    per = defaultdict(list)
    for r in plan:
        per[r["batch_id"]].append(r)
    assert len(per) == -(-1500 // 32)
    truth = {r[0]: r for r in rows}
    for batch in per.values():
        ids = [r["id"] for r in batch]
        assert len(ids) == len(set(ids)) and 28 <= len(ids) <= 32
        assert all(truth[r["id"]][1:] == (r["species"], r["modality"]) for r in batch)
        pairs = {m: {r["species"] for r in batch if r["slot"] < 12 and r["modality"] == m} for m in ("macro", "micro")}
        assert len(pairs["macro"] & pairs["micro"]) >= 4 and len({r["species"] for r in batch}) >= 9
    again = batches.plan_batches(samples.repartition(5), 32, classes=10, pairs=6, seed=7).collect()
    assert sorted(map(tuple, plan)) == sorted(map(tuple, again))
    other = batches.plan_batches(samples, 32, classes=10, pairs=6, seed=7, epoch=1).select("batch_id", "id").collect()
    assert sorted(map(tuple, other)) != sorted((r["batch_id"], r["id"]) for r in plan)


def test_pick_all_entities_even_when_weights_differ(spark):
    entities = spark.createDataFrame([("rare", 1e-3), ("a", 1.0), ("b", 1.0)], "species string, weight double")
    got = batches.pick_entities(spark.range(20).withColumnRenamed("id", "batch_id"), entities, 3)
    per = got.groupBy("batch_id").agg(F.count_distinct("species").alias("n")).collect()
    assert len(per) == 20 and {r["n"] for r in per} == {3}


def test_fill_modalities():
    assert batches.fill_modalities(8, 2, 4) == ["macro", "micro", "macro", "micro"]
    assert batches.fill_modalities(4, 0, 4) == ["macro"] * 4 and batches.fill_modalities(2, 0, 0) == ["micro"] * 2
