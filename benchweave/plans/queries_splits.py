"""Grouped splits, their reports, batch plans and pair policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from benchweave.functions.hashing import hash_uniform
from benchweave.functions.paths import group_key
from benchweave.operators import batches, pairs, splits
from benchweave.plans.dialect import h16, unit
from benchweave.plans.queries_names import D_GROUP_KEY
from benchweave.plans.registry import query
from benchweave.plans.views import check, view
from benchweave.session import keep_table

SEED = 42
UNITS = {
    "samples": f"SELECT *, {D_GROUP_KEY} AS group_key FROM items",
    "units": f"""SELECT group_key, species, modality, max(protocol_group) AS protocol_group, count(*) AS size, count(*) FILTER (phase = 'Phase1') AS p1, count(*) FILTER (phase = 'Phase2') AS p2,
                 {h16(SEED, 'group_key')} AS h FROM samples GROUP BY group_key, species, modality""",
}
D_VALFIRST = f"('0x' || substr({h16(SEED, 'species', chr(39) + 'holdout' + chr(39))}, 16, 1))::INT < 8"
SPLIT = {
    **UNITS,
    "ranked": "SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY species, modality ORDER BY size DESC, h) AS rd FROM units WINDOW w AS (PARTITION BY species, modality)",
    "lows": "SELECT *, CASE WHEN rd > 1 THEN row_number() OVER (PARTITION BY species, modality, rd > 1 ORDER BY size, h, group_key) END AS ra FROM ranked",
    "seeded": f"""SELECT *, CASE WHEN rd = 1 THEN 'train' WHEN n = 2 THEN CASE WHEN ({D_VALFIRST}) <> (modality = 'micro') THEN 'val' ELSE 'test' END
                  WHEN ra = 1 THEN CASE WHEN {D_VALFIRST} THEN 'val' ELSE 'test' END WHEN ra = 2 THEN CASE WHEN {D_VALFIRST} THEN 'test' ELSE 'val' END END AS seed_split FROM lows""",
    "mids": """SELECT *, (sum(CASE WHEN seed_split IS NULL THEN size ELSE 0 END) OVER (PARTITION BY species, modality ORDER BY h, group_key ROWS UNBOUNDED PRECEDING) - size / 2.0)
               / greatest(sum(CASE WHEN seed_split IS NULL THEN size ELSE 0 END) OVER (PARTITION BY species, modality), 1) AS mid FROM seeded""",
    "assigned": """SELECT group_key, species, modality, size, p1, p2, coalesce(seed_split, CASE WHEN mid < 0.7::DOUBLE THEN 'train' WHEN mid < 0.7::DOUBLE + 0.15::DOUBLE THEN 'val' ELSE 'test' END) AS split FROM mids""",
}
ROWS = {**SPLIT, "rows": "SELECT s.*, a.split FROM samples s JOIN assigned a USING (group_key)"}
# A plain hash split, uneven on purpose: the input of counters, repair and leak checks.
ROUGH = {**UNITS, "rough": f"SELECT *, CASE WHEN {unit(7, 'group_key')} < 0.6 THEN 'train' WHEN {unit(7, 'group_key')} < 0.8 THEN 'val' ELSE 'test' END AS split FROM units"}


def samples(spark, sf):
    return view(spark, sf, "items").withColumn("group_key", group_key())


def units(spark, sf):
    return splits.group_units(samples(spark, sf))


def rough(spark, sf):
    u = hash_uniform(7, "group_key")
    return units(spark, sf).withColumn("split", F.when(u < 0.6, "train").when(u < 0.8, "val").otherwise("test"))


def rows(spark, sf):
    every = samples(spark, sf)
    return splits.split_by_cuts(every, splits.quota_cuts(splits.group_sizes(every), seed=SEED), SEED)


@query("agg_group_units", check("items", "SELECT group_key, species, modality, protocol_group, size, p1, p2 FROM units", **UNITS))
def _(spark, sf):
    phase = lambda p: F.coalesce(F.try_element_at("phase_counts", F.lit(p)), F.lit(0))
    return units(spark, sf).select("group_key", "species", "modality", "protocol_group", "size", phase("Phase1").alias("p1"), phase("Phase2").alias("p2"))


D_DIM = """SELECT 'total' AS dimension, '' AS item, {x} sum(size) AS n FROM {t} GROUP BY ALL UNION ALL SELECT 'modality', modality, {x} sum(size) FROM {t} GROUP BY ALL
           UNION ALL SELECT 'phase', 'Phase1', {x} sum(p1) FROM {t} GROUP BY ALL UNION ALL SELECT 'phase', 'Phase2', {x} sum(p2) FROM {t} GROUP BY ALL"""
D_SHARES = "SELECT * FROM (VALUES ('train', 0.7::DOUBLE), ('val', 0.15::DOUBLE), ('test', 0.15::DOUBLE)) v(split, ratio)"


@query(
    "agg_targets",
    check("items", "SELECT dimension, item, split, n AS total, round(n * ratio, 6) AS target FROM dims0 CROSS JOIN shares", **UNITS, dims0=D_DIM.format(t="units", x=""), shares=D_SHARES),
)
def _(spark, sf):
    return splits.targets(units(spark, sf)).withColumn("target", F.round("target", 6))


@query("agg_split_counters", check("items", "SELECT * FROM c", **ROUGH, c=D_DIM.format(t="rough", x="split,")))
def _(spark, sf):
    return splits.split_counters(rough(spark, sf))


@query(
    "agg_distribution_error",
    check(
        "items",
        "SELECT round(sum(e * CASE dimension WHEN 'total' THEN 1 WHEN 'modality' THEN 0.35 ELSE 0.2 END), 8) AS error FROM (SELECT dimension, item, sum(abs(coalesce(c.n, 0) - d.n * ratio)) / max(d.n) AS e FROM dims0 d CROSS JOIN shares LEFT JOIN c USING (dimension, item, split) GROUP BY ALL)",
        **ROUGH,
        dims0=D_DIM.format(t="units", x=""),
        shares=D_SHARES,
        c=D_DIM.format(t="rough", x="split,"),
    ),
)
def _(spark, sf):
    base = rough(spark, sf)
    return splits.distribution_error(splits.split_counters(base), splits.targets(base)).withColumn("error", F.round("error", 8))


@query("win_entity_order", check("items", f"SELECT species, n_groups, samples, row_number() OVER (ORDER BY n_groups, samples DESC, {h16(SEED, 'species')}) AS rank FROM (SELECT species, count(*) AS n_groups, sum(size) AS samples FROM units GROUP BY 1)", **UNITS))
def _(spark, sf):
    return splits.entity_order(units(spark, sf), SEED)


@query("win_group_order", check("items", "SELECT group_key, row_number() OVER (PARTITION BY species ORDER BY size DESC, h) AS rank FROM units", **UNITS))
def _(spark, sf):
    return splits.group_order(units(spark, sf), SEED).select("group_key", "rank")


D_NEED = f"""SELECT species, modality, n_groups, CASE WHEN n_groups >= 3 THEN 'train,val,test' WHEN n_groups = 2 THEN 'train,' || CASE WHEN ({D_VALFIRST}) <> (modality = 'micro') THEN 'val' ELSE 'test' END
             ELSE 'train' END AS required FROM (SELECT species, modality, count(*) AS n_groups FROM thin GROUP BY 1, 2 UNION ALL SELECT species, '', count(*) FROM thin GROUP BY 1)"""


@query("spl_required", check("items", "SELECT * FROM need", **UNITS, thin="SELECT * REPLACE (species || ' ' || substr(h, 1, 2) AS species) FROM units", need=D_NEED))
def _(spark, sf):
    """All groups; entities are cut finer, so that some have only one or two groups."""
    from benchweave.functions.hashing import stable_hash

    finer = F.concat_ws(" ", "species", F.substring(stable_hash(SEED, "group_key"), 1, 2))
    return splits.required_splits(units(spark, sf).withColumn("species", finer), SEED)


@query("spl_seed_groups", check("items", "SELECT group_key, species, modality, size, seed_split AS split FROM seeded WHERE seed_split IS NOT NULL", **SPLIT))
def _(spark, sf):
    return splits.seed_groups(units(spark, sf), SEED).select("group_key", "species", "modality", "size", "split")


@query("spl_quota_assign", check("items", "SELECT group_key, species, modality, size, split FROM assigned", **SPLIT))
def _(spark, sf):
    return splits.grouped_split(units(spark, sf), seed=SEED).select("group_key", "species", "modality", "size", "split")


@query("spl_apply", check("items", "SELECT item_id, group_key, split FROM rows", **ROWS))
def _(spark, sf):
    return rows(spark, sf).select("item_id", "group_key", "split")


def _move_sql() -> str:
    """Best single move on the rough split, with the error of every candidate written out."""
    dims = [("total", "", "size")] + [("modality", m, f"CASE WHEN modality = '{m}' THEN size ELSE 0 END") for m in ("macro", "micro")]
    dims += [("phase", "Phase1", "p1"), ("phase", "Phase2", "p2")]
    weight = {"total": 1.0, "modality": 0.35, "phase": 0.2}
    value = lambda d, i, s: f"coalesce((SELECT n FROM c WHERE dimension = '{d}' AND item = '{i}' AND split = '{s}'), 0)"
    total = lambda d, i: f"(SELECT sum(n) FROM c WHERE dimension = '{d}' AND item = '{i}')"
    share = {"train": 0.7, "val": 0.15, "test": 0.15}
    gaps = ", ".join(f"{value(d, i, s)} - {total(d, i)} * {share[s]}::DOUBLE AS g_{d}_{i}_{s}" for d, i, _ in dims for s in share)
    scales = ", ".join(f"{total(d, i)} AS t_{d}_{i}" for d, i, _ in dims)
    now = " + ".join(f"abs(g_{d}_{i}_{s}) * {weight[d]} / t_{d}_{i}" for d, i, _ in dims for s in share)
    after = " + ".join(
        f"abs(g_{d}_{i}_{s} + CASE WHEN donor = '{s}' THEN -({m}) WHEN receiver = '{s}' THEN ({m}) ELSE 0 END) * {weight[d]} / t_{d}_{i}" for d, i, m in dims for s in share
    )
    over = " OR ".join(f"(donor = '{s}' AND g_total__{s} > 0)" for s in share)
    under = " OR ".join(f"(receiver = '{s}' AND g_total__{s} < 0)" for s in share)
    return check(
        "items",
        "SELECT group_key, donor, receiver, size, round(err, 8) AS error FROM cand WHERE err < now ORDER BY err, size, mh, group_key LIMIT 1",
        **ROUGH,
        c=D_DIM.format(t="rough", x="split,"),
        k=f"SELECT {gaps}, {scales}",
        thin="SELECT * FROM units",
        need=D_NEED,
        gm="SELECT species, modality, split, count(*) AS n FROM rough GROUP BY ALL",
        ge="SELECT species, split, count(*) AS n FROM rough GROUP BY ALL",
        mv="SELECT r.*, r.split AS donor, v.receiver, gm.n AS nm, ge.n AS ne FROM rough r JOIN gm USING (species, modality, split) JOIN ge USING (species, split), (VALUES ('train'), ('val'), ('test')) v(receiver) WHERE v.receiver <> r.split",
        cand=f"""SELECT mv.*, {after} AS err, {now} AS now, {h16(SEED, 'donor', 'receiver', 'group_key')} AS mh FROM mv, k
                 WHERE ({over}) AND ({under})
                 AND NOT (nm <= 1 AND EXISTS (SELECT 1 FROM need q WHERE q.species = mv.species AND q.modality = mv.modality AND q.required LIKE '%' || donor || '%'))
                 AND NOT (ne <= 1 AND EXISTS (SELECT 1 FROM need q WHERE q.species = mv.species AND q.modality = '' AND q.required LIKE '%' || donor || '%'))""",
    )


@query("spl_rebalance", _move_sql())
def _(spark, sf):
    return splits.best_move(rough(spark, sf), seed=SEED).withColumn("error", F.round("error", 8))


@query("spl_repaired")
def _(spark, sf):
    """The split that is written, repaired to the end; the tests hold it to its rules and to brute force."""
    return splits.repaired_split(units(spark, sf), seed=SEED).select("group_key", "species", "modality", "size", "split")


@query("agg_repaired_class_counts")
def _(spark, sf):
    """Class counts of the repaired split."""
    every = samples(spark, sf)
    kept = keep_table(splits.group_units(every))
    cuts = splits.quota_cuts(kept, seed=SEED)
    repaired = splits.rebalance(splits.split_by_cuts(kept, cuts, SEED), seed=SEED)
    return splits.class_counts(splits.apply_repaired(every, cuts, repaired, SEED), "P3")


@query(
    "spl_leak_check",
    check(
        "items",
        "SELECT group_key FROM per WHERE n > 1 UNION ALL SELECT group_key FROM clean WHERE n > 1",
        **ROWS,
        per=f"SELECT group_key, count(DISTINCT CASE WHEN {unit(3, 'item_id')} < 0.01 THEN 'test' ELSE split END) AS n FROM rows GROUP BY 1",
        clean="SELECT group_key, count(DISTINCT split) AS n FROM rows GROUP BY 1",
    ),
)
def _(spark, sf):
    split_rows = rows(spark, sf)
    dirty = split_rows.withColumn("split", F.when(hash_uniform(3, "item_id") < 0.01, "test").otherwise(F.col("split")))
    return splits.leaks(dirty).unionByName(splits.leaks(split_rows))


BALANCE = """SELECT split, count(*) AS present_species_count, min(n) AS min_samples_per_species, max(n) AS max_samples_per_species, round_even(avg(n), 4)::DOUBLE AS mean_samples_per_species,
             round_even(median(n), 4)::DOUBLE AS median_samples_per_species FROM (SELECT split, species, count(*) AS n FROM rows GROUP BY ALL) GROUP BY split"""


@query("agg_class_balance", check("items", BALANCE, **ROWS))
def _(spark, sf):
    return splits.balance_stats(rows(spark, sf))


CLASS_COUNTS = check(
    "items",
    """SELECT 'P3' AS protocol, k.split, s.species, s.protocol_group, coalesce(total, 0) AS total_samples, coalesce(g, 0) AS groups_in_split, coalesce(ma, 0) AS macro_samples, coalesce(mi, 0) AS micro_samples,
       coalesce(p1, 0) AS phase1_macro_samples, coalesce(p2, 0) AS phase2_macro_samples, (coalesce(total, 0) > 0)::INT AS present_in_split
       FROM (SELECT species, max(protocol_group) AS protocol_group FROM samples GROUP BY 1) s CROSS JOIN (VALUES ('train'), ('val'), ('test')) k(split) LEFT JOIN c ON c.species = s.species AND c.split = k.split""",
    **ROWS,
    c="""SELECT split, species, count(*) AS total, count(DISTINCT specimen_id) AS g, count(*) FILTER (modality = 'macro') AS ma, count(*) FILTER (modality = 'micro') AS mi,
         count(*) FILTER (modality = 'macro' AND phase = 'Phase1') AS p1, count(*) FILTER (modality = 'macro' AND phase = 'Phase2') AS p2 FROM rows GROUP BY ALL""",
)


@query("agg_class_counts", CLASS_COUNTS)
def _(spark, sf):
    return splits.class_counts(rows(spark, sf), "P3")


@query(
    "agg_split_summary",
    check(
        "items",
        """SELECT b.*, a.* EXCLUDE (split), round_even((SELECT count(*) FROM rows) * CASE b.split WHEN 'train' THEN 0.7::DOUBLE ELSE 0.15::DOUBLE END, 4)::DOUBLE AS target_sample_count,
           round_even(sample_count / (SELECT count(*) FROM rows), 6)::DOUBLE AS actual_ratio FROM b JOIN a USING (split)""",
        **ROWS,
        b=BALANCE,
        a="""SELECT split, count(*) AS sample_count, count(DISTINCT group_key) AS group_count, count(*) FILTER (modality = 'macro') AS macro_samples, count(*) FILTER (modality = 'micro') AS micro_samples,
             count(*) FILTER (modality = 'macro' AND phase = 'Phase1') AS phase1_macro_samples, count(*) FILTER (modality = 'macro' AND phase = 'Phase2') AS phase2_macro_samples FROM rows GROUP BY split""",
    ),
)
def _(spark, sf):
    groups = keep_table(splits.group_sizes(samples(spark, sf)))
    return splits.group_summary(splits.split_by_cuts(groups, splits.quota_cuts(groups, seed=SEED), SEED))


@query(
    "agg_split_totals",
    check(
        "items",
        "SELECT 'P3' AS protocol, 42 AS seed, 0.7::DOUBLE AS train_ratio, 0.15::DOUBLE AS val_ratio, 0.15::DOUBLE AS test_ratio, count(*) AS total_samples, count(DISTINCT group_key) AS group_count, count(DISTINCT species) AS species_count FROM rows",
        **ROWS,
    ),
)
def _(spark, sf):
    return splits.split_totals(rows(spark, sf), "P3", SEED)


@query(
    "agg_ratio_deviations",
    check(
        "items",
        """SELECT k AS split, r AS target_ratio, round_even(n / total, 6)::DOUBLE AS actual_ratio, round_even(n / total - r, 6)::DOUBLE AS delta_ratio, round_even(total * r, 4)::DOUBLE AS target_samples, n AS actual_samples
           FROM (SELECT k, r, (SELECT count(*) FROM r0 WHERE split = k) AS n, (SELECT count(*) FROM r0) AS total FROM (VALUES ('train', 0.7::DOUBLE), ('val', 0.15::DOUBLE), ('test', 0.15::DOUBLE)) v(k, r)) WHERE abs(n / total - r) > 0.01""",
        **ROUGH,
        r0="SELECT s.*, a.split FROM samples s JOIN rough a USING (group_key)",
    ),
)
def _(spark, sf):
    return splits.ratio_deviations(splits.apply_split(samples(spark, sf), rough(spark, sf)))


@query(
    "agg_split_warnings",
    check(
        "items",
        """SELECT 'too_few_groups' AS kind, species AS item FROM e WHERE g < 3 UNION ALL SELECT 'too_few_samples', species FROM e WHERE n < 7
           UNION ALL SELECT 'missing_from_val', species FROM e WHERE tr AND NOT va UNION ALL SELECT 'missing_from_test', species FROM e WHERE tr AND NOT te
           UNION ALL SELECT 'ratio', k FROM (VALUES ('train', 0.7), ('val', 0.15), ('test', 0.15)) v(k, r) WHERE abs((SELECT count(*) FROM r WHERE split = k) / (SELECT count(*) FROM r) - r) > 0.01
           UNION ALL SELECT 'modality', s || ' has no ' || m || ' samples.' FROM (VALUES ('train'), ('val'), ('test')) v(s), (VALUES ('macro'), ('micro')) w(m) WHERE NOT EXISTS (SELECT 1 FROM r WHERE split = s AND modality = m)""",
        **ROUGH,
        r="SELECT s.*, a.split FROM samples s JOIN rough a USING (group_key) WHERE NOT (a.split = 'test' AND s.modality = 'micro') AND NOT (a.split = 'val' AND s.genus = 'Hot') AND NOT (s.species = 'Red rod' AND s.specimen_id NOT IN ('11', '12'))",
        e="SELECT species, count(*) AS n, count(DISTINCT group_key) AS g, bool_or(split = 'train') AS tr, bool_or(split = 'val') AS va, bool_or(split = 'test') AS te FROM r GROUP BY 1",
    ),
)
def _(spark, sf):
    every = splits.apply_split(samples(spark, sf), rough(spark, sf))
    kept = every.where(
        ~((F.col("split") == "test") & (F.col("modality") == "micro"))
        & ~((F.col("split") == "val") & (F.col("genus") == "Hot"))
        & ~((F.col("species") == "Red rod") & ~F.col("specimen_id").isin("11", "12"))
    )
    return splits.split_warnings(kept)


# --- batches and pairs ---


def items_small(spark, sf):
    return view(spark, sf, "items").select(F.col("item_id").alias("id"), "species", "modality")


@query(
    "win_pool_shuffle",
    check("items", f"SELECT item_id AS id, species, modality, row_number() OVER (PARTITION BY species, modality ORDER BY {h16(SEED + 1, 'species', 'modality', '2', 'item_id')}) - 1 AS pool_rank FROM items"),
)
def _(spark, sf):
    return batches.pool_order(items_small(spark, sf), SEED, epoch=1, cycle=2)


BATCH, PICKS = 128, 4


@query(
    "smp_species_pick",
    check(
        "items",
        f"SELECT batch_id, species, place FROM (SELECT batch_id, species, row_number() OVER (PARTITION BY batch_id ORDER BY j) AS place FROM seen) WHERE place <= {PICKS}",
        w="SELECT species, 1 / power(count(*), 0.5) AS weight FROM items GROUP BY 1",
        iv="SELECT species, (sum(weight) OVER (ORDER BY species) - weight) / sum(weight) OVER () AS lo, sum(weight) OVER (ORDER BY species) / sum(weight) OVER () AS hi FROM w",
        d=f"SELECT batch_id, j, {unit(SEED, chr(39) + 'pick' + chr(39), 'batch_id', 'j')} AS u FROM range((SELECT (count(*) + {BATCH - 1}) // {BATCH} FROM items)) b(batch_id), range({4 * PICKS + 16}) r(j)",
        seen="SELECT batch_id, species, min(j) AS j FROM d JOIN iv ON u >= lo AND u < hi GROUP BY ALL",
    ),
)
def _(spark, sf):
    items = items_small(spark, sf)
    steps = -(-items.count() // BATCH)
    numbers = spark.range(steps).select(F.col("id").alias("batch_id"))
    picked = batches.pick_entities(numbers, batches.entity_weights(items), PICKS, SEED)
    return picked.withColumn("place", F.col("place").cast("bigint"))


@query("smp_batch_plan")
def _(spark, sf):
    """A whole epoch of batches; seeded draws are checked for their rules in the tests."""
    return batches.plan_batches(items_small(spark, sf), BATCH, classes=32, pairs=16, seed=SEED)


@query(
    "smp_batch_audit",
    check(
        "emb",
        """SELECT batch_id, sum(a + b) AS size, sum(a) AS macro, sum(b) AS micro, count(*) AS species, count(*) FILTER (a > 0 AND b > 0) AS paired_species
           FROM (SELECT batch_id, species, count(*) FILTER (modality = 'macro') AS a, count(*) FILTER (modality = 'micro') AS b FROM emb GROUP BY ALL) GROUP BY batch_id""",
    ),
)
def _(spark, sf):
    return batches.audit_batches(view(spark, sf, "emb"))


D_PAIRS = """SELECT a.batch_id, a.id AS macro_id, b.id AS micro_id, CASE WHEN a.species = b.species THEN 'exact' WHEN a.genus = b.genus THEN 'genus_soft' ELSE 'unrelated' END AS relation
             FROM emb a JOIN emb b ON a.batch_id = b.batch_id AND a.modality = 'macro' AND b.modality = 'micro'"""


@query("join_pair_relations", check("emb", D_PAIRS))
def _(spark, sf):
    return pairs.pair_relations(view(spark, sf, "emb"))


@query(
    "agg_pair_counts",
    check(
        "emb",
        """SELECT batch_id, count(*) FILTER (relation = 'exact') AS exact_pairs, count(*) FILTER (relation = 'genus_soft') AS genus_pairs,
           count(DISTINCT CASE WHEN relation = 'exact' THEN macro_id END) + count(DISTINCT CASE WHEN relation = 'exact' THEN micro_id END) AS exact_anchors,
           count(DISTINCT CASE WHEN relation = 'genus_soft' THEN macro_id END) + count(DISTINCT CASE WHEN relation = 'genus_soft' THEN micro_id END) AS genus_anchors FROM p GROUP BY 1""",
        p=D_PAIRS,
    ),
)
def _(spark, sf):
    return pairs.pair_counts(view(spark, sf, "emb"))


def _loss_steps(policy: str) -> dict[str, str]:
    positive = {"genus_only": "a.genus = b.genus AND a.species <> b.species"}.get(policy, "a.assigned = b.assigned")
    weight = "1.0::DOUBLE"
    if policy == "exact_plus_genus_relaxed_negative":
        weight = "CASE WHEN a.modality <> b.modality AND a.genus = b.genus AND a.species <> b.species THEN 0.5 ELSE 1.0 END"
    if policy == "genus_only":
        weight = "CASE WHEN a.modality <> b.modality AND a.species = b.species THEN 0.0 ELSE 1.0 END"
    category = {"shuffled_exact_control": "species", "hard_negative_control": "genus"}.get(policy)
    steps = {}
    if category is None:
        steps["lab"] = "SELECT *, species AS assigned FROM emb"
    else:
        steps["mi"] = f"SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY {category}, {h16(SEED, 'batch_id', 'id')}, id) - 1 AS pos, count(*) OVER (PARTITION BY batch_id) AS n, count(*) OVER (PARTITION BY batch_id, {category}) AS c FROM emb WHERE modality = 'micro'"
        steps["mm"] = "SELECT *, max(c) OVER (PARTITION BY batch_id) AS m FROM mi"
        steps["lab"] = """SELECT e.*, e.species AS assigned FROM emb e WHERE modality = 'macro'
                          UNION ALL SELECT e.*, t.species AS assigned FROM emb e JOIN mm ON mm.id = e.id LEFT JOIN mm t ON t.batch_id = mm.batch_id AND mm.n > 1 AND 2 * mm.m <= mm.n AND t.pos = (mm.pos + mm.m) % mm.n"""
    steps["pr"] = f"""SELECT a.batch_id, a.id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim, a.modality <> b.modality AND {positive} AS pos,
                      CASE WHEN a.modality <> b.modality AND {positive} THEN 1.0 ELSE {weight} END AS w, a.modality <> b.modality AND a.genus = b.genus AND a.species <> b.species AS soft
                      FROM lab a JOIN lab b ON a.batch_id = b.batch_id AND a.id <> b.id"""
    steps["an"] = """SELECT batch_id, id, ln(sum(w * exp((sim - 1) / 0.07))) + 1 / 0.07 AS lse, avg(sim / 0.07) FILTER (pos) AS mp, count(*) FILTER (pos) AS np,
                     coalesce(sum(greatest(0.35 - sim, 0)) FILTER (soft), 0) AS hs, count(*) FILTER (soft) AS hn FROM pr GROUP BY ALL"""
    steps["ls"] = """SELECT batch_id, round(coalesce(avg(lse - mp) FILTER (np > 0), 0), 5) AS contrast_loss, count(*) FILTER (np > 0) AS anchors,
                     round(CASE WHEN sum(hn) > 0 THEN sum(hs) / sum(hn) ELSE 0 END, 5) AS genus_loss, cast(sum(hn) / 2 AS bigint) AS genus_pairs FROM an GROUP BY batch_id"""
    return steps


def _losses(spark, sf, policy):
    out = pairs.pair_losses(view(spark, sf, "emb"), policy, seed=SEED)
    return out.withColumns({c: F.round(c, 5) for c in ("contrast_loss", "genus_loss")})


@query("agg_supcon", check("emb", "SELECT batch_id, contrast_loss, anchors FROM ls", **_loss_steps("exact_only")))
def _(spark, sf):
    return _losses(spark, sf, "exact_only").select("batch_id", "contrast_loss", "anchors")


@query("agg_genus_hinge", check("emb", "SELECT batch_id, genus_loss, genus_pairs FROM ls", **_loss_steps("exact_only")))
def _(spark, sf):
    return _losses(spark, sf, "exact_only").select("batch_id", "genus_loss", "genus_pairs")


POLICY_QUERIES = {
    "pol_genus_soft": "exact_plus_genus_soft",
    "pol_relaxed_negative": "exact_plus_genus_relaxed_negative",
    "pol_genus_only": "genus_only",
    "pol_shuffled_control": "shuffled_exact_control",
    "pol_hard_negative_control": "hard_negative_control",
}


def _register_policy(name: str, policy: str) -> None:
    @query(name, check("emb", "SELECT * FROM ls", **_loss_steps(policy)))
    def _(spark, sf):
        return _losses(spark, sf, policy)


for _name, _policy in POLICY_QUERIES.items():
    _register_policy(_name, _policy)


@query("pol_exact", check("emb", "SELECT * FROM p WHERE relation = 'exact'", p=D_PAIRS))
def _(spark, sf):
    return pairs.exact_pairs(view(spark, sf, "emb"))


@query("pol_active_pairs", check("emb", """SELECT a.batch_id, count(b.id) AS pairs, count(DISTINCT CASE WHEN b.id IS NOT NULL THEN a.id END) + count(DISTINCT b.id) AS anchors
       FROM lab a LEFT JOIN lab b ON a.batch_id = b.batch_id AND b.modality = 'micro' AND a.assigned = b.assigned WHERE a.modality = 'macro' GROUP BY 1""", **{k: v for k, v in _loss_steps("shuffled_exact_control").items() if k in ("mi", "mm", "lab")}))
def _(spark, sf):
    return pairs.active_pairs(view(spark, sf, "emb"), "shuffled_exact_control", SEED)
