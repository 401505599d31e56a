import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from benchweave.operators import calibration, history, metrics, pairs, retrieval
from benchweave.operators.ranking import percentiles, running_max, running_total


def test_running_total_with_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", i, rng.randrange(10)) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o int, v int").repartition(7)
    got = {(r["k"], r["o"]): (r["s"], r["m"]) for r in running_max(running_total(df, ["k"], ["o"], "v", "s"), ["k"], ["o"], "v", "m").collect()}
    sums, tops = {}, {}
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        before = tops.get(k)
        sums[k] = sums.get(k, 0) + v
        assert got[(k, o)] == (sums[k], before)
        tops[k] = v if before is None else max(before, v)


def test_percentiles_interpolate(spark):
    rng = random.Random(2)
    data = {"a": [rng.random() for _ in range(501)], "b": [5.0], "c": [1.0, 1.0, 2.0]}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v double")
    for r in percentiles(df, ["k"], "v", {"p05": 0.05, "p95": 0.95, "med": 0.5}).collect():
        want = np.percentile(data[r["k"]], [5, 95, 50])
        assert np.allclose([r["p05"], r["p95"], r["med"]], want)
    lone = metrics.latency_summary(df.withColumnRenamed("k", "run").withColumnRenamed("v", "latency_ms")).where("run = 'b'").first()
    assert lone["std_ms"] == 0.0 and lone["p95_ms"] == 5.0


def test_per_class_edges(spark):
    preds = spark.createDataFrame([(0, 0), (0, 1), (2, 1)], "true_label bigint, pred_label bigint")
    classes = spark.range(4).withColumnRenamed("id", "class_index")
    table = metrics.per_class(metrics.confusion(preds), classes)
    rows = {r["class_index"]: r for r in table.collect()}
    assert rows[1]["support"] == 0 and rows[1]["precision"] == 0.0 and rows[1]["false_positives"] == 2
    assert rows[3]["f1"] == 0.0 and rows[2]["recall"] == 0.0
    s = metrics.classification_summary(table).first()
    assert s["num_classes"] == 4 and abs(s["balanced_accuracy"] - 0.25) < 1e-12 and abs(s["top1_accuracy"] - 1 / 3) < 1e-12


def test_loss_means_quirk_and_blend(spark):
    steps = spark.createDataFrame([("s", 1.0, 1.0, 0.0, 2.0, 0.0, 2, 0, 0, 0), ("s", 3.0, 3.0, 0.0, 4.0, 0.0, 2, 0, 1, 0)], "stage string, total_loss double, macro_loss double, micro_loss double, contrast_loss double, genus_loss double, macro_samples int, micro_samples int, anchors int, genus_pairs int")
    row = metrics.loss_means(steps, ["stage"]).first()
    assert row["total_loss"] == 2.0 and row["micro_loss"] is None and row["genus_loss"] is None
    assert row["contrast_loss"] == 6.0  # (2*max(1,0) + 4*1) / (0 + 1)
    df = spark.createDataFrame([(0.5, None), (None, 0.2), (None, None), (1.0, 0.0)], "a double, b double")
    assert [r[0] for r in df.select(metrics.tradeoff("a", "b")).collect()] == [0.5, 0.2, 0.0, 0.8]


def test_seed_summary(spark):
    rows = spark.createDataFrame([("m", 1, 0.5), ("m", 2, 0.7), ("n", 1, 0.25)], "model string, seed int, x double")
    models = spark.createDataFrame([("m", "M"), ("n", "N"), ("z", "Z")], "model string, display_name string")
    got = {r["model"]: r for r in metrics.seed_summary(rows, models, ["x"]).collect()}
    assert got["m"]["x"] == "60.00 ± 14.14" and got["n"]["x"] == "25.00 ± 0.00" and got["z"]["x"] == "NA"
    assert got["z"]["warning"] == "WARNING: Z has only 0/3 seeds"


def test_calibration_on_grid_points(spark):
    conf = [0.0, 0.85, 0.85, 1.0, 0.005, 0.8499999999999, 0.29, 0.57, 0.58]
    df = spark.createDataFrame([(c, i % 2) for i, c in enumerate(conf)], "confidence double, correct int")
    curve = {round(r["tau"] * 200): r for r in calibration.calibrate(df).collect()}
    assert len(curve) == 201
    for i, r in curve.items():
        kept = [j % 2 for j, c in enumerate(conf) if c >= i / 200]
        assert r["n_flagged"] == len(conf) - len(kept) and abs(r["coverage"] - len(kept) / len(conf)) < 1e-12
        assert r["precision"] == (sum(kept) / len(kept) if kept else None)
    never = calibration.pick_threshold(calibration.calibrate(df), [2.0]).first()
    assert never["tau"] is None
    picked = calibration.pick_threshold(calibration.calibrate(df), [0.4]).first()
    assert picked["tau"] == 0.0 or picked["precision"] >= 0.4


def brute_top(q, g, k, exclude):
    out = {}
    for qi, _, _, qv in q:
        sims = []
        for gi, gs, _, gv in g:
            if exclude and gi == qi:
                continue
            a, b = np.array(qv), np.array(gv)
            sims.append((-round(float(a @ b / max(np.linalg.norm(a), 1e-12) / max(np.linalg.norm(b), 1e-12)), 9), gi))
        out[qi] = [gi for _, gi in sorted(sims)[:k]]
    return out


EMB = "id string, species string, genus string, embedding array<float>"


def test_top_k_equals_brute_force_over_many_blocks(spark):
    rng = np.random.default_rng(4)
    vec = lambda: [float(x) for x in rng.integers(-2, 3, 4)]  # coarse values make ties, and zero vectors
    g = [(f"x{i:03d}", f"s{i % 5}", f"g{i % 2}", vec()) for i in range(150)]
    q = g[:40] + [(f"q{i}", "none", "none", vec()) for i in range(30)]
    got = {}
    for r in retrieval.top_k(spark.createDataFrame(q, EMB), spark.createDataFrame(g, EMB), 5, True, block_rows=16).collect():
        got.setdefault(r["q_id"], []).append((r["rank"], r["g_id"]))
    assert {k: [i for _, i in sorted(v)] for k, v in got.items()} == brute_top(q, g, 5, True)
    small = retrieval.top_k(spark.createDataFrame(q[:2], EMB), spark.createDataFrame(g[:3], EMB), 5, True)
    assert small.groupBy("q_id").count().agg(F.max("count")).first()[0] == 2  # gallery smaller than k, itself left out


def test_mean_loss_skips_batches_without_one(spark):
    steps = spark.createDataFrame([("a", 1.0, 2), ("a", 4.0, 1), ("a", None, 50), ("b", None, 3)], "run string, loss double, batch_size int")
    assert sorted(map(tuple, metrics.mean_loss(steps, ["run"]).collect())) == [("a", 2.0, 3), ("b", None, 0)]
    assert metrics.mean_loss(steps.limit(0)).first()["mean_loss"] is None


def test_queries_sharing_an_id_stay_apart(spark):
    q = spark.createDataFrame([("a", "S", "G", [1.0, 0.0]), ("a", "T", "H", [0.0, 1.0]), ("a", "T", "H", [0.0, 1.0])], EMB)
    g = spark.createDataFrame([("x", "S", "G", [1.0, 0.1]), ("y", "T", "H", [0.1, 1.0]), ("a", "S", "G", [1.0, 0.0]), ("a", "S", "G", [0.0, 1.0])], EMB)
    top = retrieval.top_k(q, g, 1).select("q_species", "g_id").collect()
    assert sorted(map(tuple, top)) == [("S", "x"), ("T", "y"), ("T", "y")]
    scored = retrieval.score_queries(q, g, 1).collect()
    assert len(scored) == 3 and all(r["exact_r1"] == 1 and r["eligible_exact"] == 1 for r in scored)
    alone = retrieval.eligible(q, g.where("id = 'a'")).collect()
    assert len(alone) == 3 and not any(r["eligible_exact"] or r["eligible_genus"] for r in alone)


def test_eligibility_and_errors(spark):
    q = spark.createDataFrame([("a", "S", "G", [1.0]), ("b", "T", "G", [1.0]), ("c", "U", "H", [1.0])], EMB)
    g = spark.createDataFrame([("a", "S", "G", [1.0]), ("d", "S", "G", [0.5])], EMB)
    rows = {r["id"]: (r["eligible_exact"], r["eligible_genus"]) for r in retrieval.eligible(q, g).collect()}
    assert rows == {"a": (1, 1), "b": (0, 1), "c": (0, 0)}
    alone = retrieval.eligible(q, g.where("id = 'a'"))
    assert {r["id"]: r["eligible_exact"] for r in alone.collect()}["a"] == 0
    with pytest.raises(ValueError):
        retrieval.require_eligible(alone)
    none = retrieval.direction_report(retrieval.score_queries(q.where("id = 'c'"), g, exclude_self=False), g, "x").first()
    assert none["exact_recall_at_1"] is None and none["query_count"] == 1


def test_bootstrap_centre_and_suite(spark):
    hits = spark.createDataFrame([("t", f"q{i}", int(i % 4 == 0)) for i in range(400)], "task string, id string, hit int")
    row = retrieval.bootstrap_ci(hits, ["task"], 300, 42).first()
    assert row["point_estimate"] == 0.25 and abs(row["mean"] - 0.25) < 0.01
    assert abs(row["std"] - math.sqrt(0.25 * 0.75 / 400)) < 0.004 and row["ci_lower"] < 0.25 < row["ci_upper"]
    rng = np.random.default_rng(1)
    emb = [(f"v{i}", ["macro", "micro"][i % 2], f"G{i // 2 % 3} s{i // 2 % 6}", f"G{i // 2 % 3}", [float(x) for x in rng.normal(size=4)]) for i in range(80)]
    df = spark.createDataFrame(emb, "id string, modality string, species string, genus string, embedding array<float>")
    suite = {r["task"]: r for r in retrieval.bootstrap_suite(df, 50).collect()}
    assert sorted(suite) == ["M2m_exact_R1", "M2m_exact_R5", "M2m_genus_R1", "m2M_exact_R1", "m2M_exact_R5", "m2M_genus_R1"]
    assert suite["M2m_exact_R5"]["seed"] == 42 + 10003 and suite["m2M_genus_R1"]["seed"] == 42 + 300000
    macro, micro = retrieval.split_modalities(df)
    single = retrieval.bootstrap_ci(retrieval.hit_rows(retrieval.score_queries(macro, micro), "M2m", "exact", 42), ["task", "seed"], 50, "seed").where("task = 'M2m_exact_R1'").first()
    assert abs(single["mean"] - suite["M2m_exact_R1"]["mean"]) < 1e-12


def test_min_delta_fold(spark):
    rng = random.Random(6)
    rows = [(run, e, rng.random() + e * 0.01) for run in ("a", "b") for e in range(200)]
    df = spark.createDataFrame(rows, "run string, epoch bigint, metric double").repartition(5)
    got = {(r["run"], r["epoch"]) for r in history.accepted_bests(df, 0.05).collect()}
    want, stops = set(), {}
    for run in ("a", "b"):
        best, waited = None, 0
        for _, e, m in [r for r in rows if r[0] == run]:
            if best is None or m - best > 0.05:
                best, waited = m, 0
                want.add((run, e))
            else:
                waited += 1
                if waited == 15 and run not in stops:
                    stops[run] = e
    assert got == want
    stopped = {r["run"]: r["stop_epoch"] for r in history.early_stop(df, 15, min_delta=0.05).collect()}
    assert stopped == {run: stops.get(run) for run in ("a", "b")}
    low = history.running_best(df, mode="min").where("run = 'a' and epoch = 199").first()
    assert low["best_metric"] == min(m for r, _, m in rows if r == "a")


def accepted_of(values, delta):
    best, out = None, []
    for i, m in enumerate(values):
        if m is not None and not math.isnan(m) and (best is None or m - best > delta):
            best = m
            out.append(i)
    return out


def test_long_runs_in_pieces(spark):
    """Bests of long runs, cut into pieces, equal a walk from end to end: dense, sparse, tied and mixed values."""
    rng = random.Random(11)
    series = {
        "rising": [i * 0.01 for i in range(900)],
        "tiny": [1 + i * 1e-9 for i in range(700)],
        "random": [rng.random() + i * 0.002 for i in range(1000)],
        "jumps": [float(i // 50) * 0.3 + rng.random() * 0.01 for i in range(800)],
        "around": [-3.0 + i * 0.005 for i in range(1200)],
        "short": [0.5, 0.4, None, float("nan"), 0.9],
        "wide": [float("-inf"), *[1e-300 * 2.0**i for i in range(1000)], float("inf"), float("inf")],
    }
    rows = [(run, i, m) for run, values in series.items() for i, m in enumerate(values)]
    df = spark.createDataFrame(rows, "run string, epoch bigint, metric double").repartition(5)
    for delta, piece in ((0.0, 128), (0.0371, 16)):
        got = sorted((r["run"], r["epoch"]) for r in history.accepted_bests(df, delta, piece=piece).collect())
        assert got == sorted((run, i) for run, values in series.items() for i in accepted_of(values, delta)), delta
    low = {(r["run"], r["epoch"]) for r in history.accepted_bests(df.withColumn("metric", -F.col("metric")), 0.03, mode="min", piece=64).collect()}
    assert low == {(run, i) for run, values in series.items() for i in accepted_of(values, 0.03)}


def test_least_accepted():
    rng = np.random.default_rng(0)
    best = np.concatenate([rng.normal(size=50), [0.0, -0.0, -5.0, -4.9999999, 1e300, -1e300, np.inf, -np.inf, 5e-324]])
    for delta in (0.0, 1e-9, 0.1, 5.0):
        limit = history.least_accepted(best, delta)
        with np.errstate(invalid="ignore"):
            finite = best < np.inf
            assert (limit - best > delta)[finite].all()
            assert not (np.nextafter(limit, -np.inf) - best > delta).any()


def brute_loss(items, positive, weight, t=0.07):
    vecs = [np.array(i[5]) / np.linalg.norm(i[5]) for i in items]
    losses = []
    for i, a in enumerate(items):
        others = [j for j in range(len(items)) if j != i]
        pos = [j for j in others if positive(a, items[j])]
        if not pos:
            continue
        logit = {j: float(vecs[i] @ vecs[j]) / t for j in others}
        total = sum(math.exp(logit[j]) * (1.0 if j in pos else weight(a, items[j])) for j in others)
        losses.append(-sum(logit[j] - math.log(total) for j in pos) / len(pos))
    return sum(losses) / len(losses) if losses else 0.0


def test_losses_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(8)
    items = [(0, f"i{i}", ["macro", "micro"][i % 2], f"s{i % 7}", f"g{i % 3}", [float(x) for x in rng.normal(size=3)]) for i in range(60)]
    df = spark.createDataFrame(items, "batch_id bigint, id string, modality string, species string, genus string, embedding array<float>")
    cross = lambda a, b: a[2] != b[2]
    exact = lambda a, b: cross(a, b) and a[3] == b[3]
    soft = lambda a, b: cross(a, b) and a[4] == b[4] and a[3] != b[3]
    cases = {
        "exact_only": (exact, lambda a, b: 1.0),
        "exact_plus_genus_relaxed_negative": (exact, lambda a, b: 0.5 if soft(a, b) else 1.0),
        "genus_only": (soft, lambda a, b: 0.0 if exact(a, b) else 1.0),
    }
    for policy, (positive, weight) in cases.items():
        want = brute_loss(items, positive, weight)
        for rows in (1024, 13):
            got = pairs.pair_losses(df, policy, block_rows=rows).first()
            assert abs(got["contrast_loss"] - want) < 1e-5, (policy, rows)
    hard = pairs.policy_loss(df, "exact_only").first()
    assert hard["loss"] == hard["contrast_loss"]


def test_control_labels(spark):
    def labels(species):
        rows = [(0, f"m{i}", "micro", s, s) for i, s in enumerate(species)] + [(0, "x", "macro", "A", "A")]
        df = spark.createDataFrame(rows, "batch_id bigint, id string, modality string, species string, genus string")
        return {r["id"]: (r["species"], r["assigned"]) for r in pairs.control_labels(df).collect()}

    ok = labels("AABB")
    assert all(a != s for i, (s, a) in ok.items() if i != "x") and sorted(a for i, (_, a) in ok.items() if i != "x") == list("AABB")
    assert all(a is None for i, (_, a) in labels("AAB").items() if i != "x")
    assert labels("A")["m0"][1] is None and labels("A")["x"] == ("A", "A")


def test_nan_and_null_metrics_never_improve(spark):
    rows = [("a", 0, float("nan")), ("a", 1, 0.5), ("a", 2, None), ("a", 3, float("nan")), ("a", 4, 0.6), ("b", 0, float("nan"))]
    df = spark.createDataFrame(rows, "run string, epoch long, metric double")
    got = {(r["run"], r["epoch"]): (r["improved"], r["best_epoch"]) for r in history.running_best(df).collect()}
    assert got == {("a", 0): (0, None), ("a", 1): (1, 1), ("a", 2): (0, 1), ("a", 3): (0, 1), ("a", 4): (1, 4), ("b", 0): (0, None)}


def test_confidences_outside_the_grid_stay_in_the_total(spark):
    rows = [(-0.1, True), (float("nan"), True), (None, False), (0.5, True), (1.5, False)]
    df = spark.createDataFrame(rows, "confidence double, correct boolean")
    curve = {round(r["tau"], 3): r for r in calibration.calibrate(df, 10).collect()}
    assert (curve[0.0]["coverage"], curve[0.0]["n_flagged"]) == (0.4, 3)
    assert (curve[1.0]["coverage"], curve[1.0]["precision"], curve[1.0]["n_flagged"]) == (0.2, 0.0, 4)


def test_percentiles_in_rounds(spark):
    """Ranks found by digits equal those of a sort: many magnitudes, ties, both signs, infinities, one hot key."""
    rng = np.random.default_rng(3)
    groups = {
        "wide": rng.choice([-1, 1], 3000) * 10.0 ** rng.uniform(-300, 300, 3000),
        "close": 1.0 + rng.integers(0, 4000, 6000) * 2.0**-52,
        "ties": np.repeat([0.0, -0.0, 5.0], 700),
        "small": rng.integers(-2000, 2000, 3000) * 5e-324,
        "ends": np.array([-np.inf, 1.0, 2.0, np.inf, np.inf]),
        "one": np.array([7.25]),
    }
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("one", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    points = {"p0": 0.0, "p05": 0.05, "med": 0.5, "p95": 0.95, "p1": 1.0}
    for few in (1, 50, 1 << 16):
        got = {r["k"]: r for r in percentiles(df, ["k"], "v", points, few).collect()}
        assert set(got) == set(groups)
        for k, vs in groups.items():
            line = sorted(vs.tolist())
            for name, p in points.items():
                rank = (len(line) - 1) * p
                low, w = math.floor(rank), rank - math.floor(rank)
                want = line[low] if w == 0 else line[low] * (1.0 - w) + line[math.ceil(rank)] * w
                assert got[k][name] == want, (few, k, name)
