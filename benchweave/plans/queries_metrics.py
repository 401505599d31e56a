"""Classification, calibration, latency, seeds and training-history queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from benchweave.functions.vectors import cosine_distance, softmax_top
from benchweave.operators import calibration, history, metrics
from benchweave.plans.registry import query
from benchweave.plans.views import check, view

D_PRED = """SELECT vec_id, cast(true_label AS bigint) AS true_label, cast(list_position(s, list_max(s)) - 1 AS bigint) AS pred_label
            FROM (SELECT vec_id, true_label, scores::DOUBLE[] AS s FROM scores)"""
D_CLASS = """SELECT c AS class_index, sum(s) AS support, sum(t) AS tp, sum(p) AS predicted FROM (
             SELECT true_label AS c, 1 AS s, 0 AS p, (true_label = pred_label)::int AS t FROM pred UNION ALL SELECT pred_label, 0, 1, 0 FROM pred) GROUP BY 1"""
D_PRF = """SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r FROM cls"""
D_F1 = "CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END"


def predictions(spark, sf):
    top, confidence = softmax_top("scores")
    rows = view(spark, sf, "scores")
    return rows.select("vec_id", F.col("true_label").cast("bigint").alias("true_label"), top.alias("pred_label"), confidence.alias("confidence"))


@query("agg_confusion", check("scores", "SELECT true_label, pred_label, count(*) AS n FROM pred GROUP BY ALL", pred=D_PRED))
def _(spark, sf):
    return metrics.confusion(predictions(spark, sf))


@query(
    "agg_confusion_wide",
    check("scores", "SELECT true_label, " + ", ".join(f"count(*) FILTER (pred_label = {c}) AS pred_{c}" for c in range(10)) + " FROM pred GROUP BY 1", pred=D_PRED),
)
def _(spark, sf):
    return metrics.confusion_wide(metrics.confusion(predictions(spark, sf)), range(10))


@query(
    "agg_per_class",
    check(
        "scores",
        f"""SELECT class_index, support, tp AS true_positives, predicted - tp AS false_positives, support - tp AS false_negatives,
            round(p, 6) AS "precision", round(r, 6) AS recall, round({D_F1}, 6) AS f1 FROM prf""",
        pred=D_PRED,
        cls=D_CLASS,
        prf=D_PRF,
    ),
)
def _(spark, sf):
    out = metrics.per_class(metrics.confusion(predictions(spark, sf)))
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(
    "agg_cls_summary",
    check(
        "scores",
        f"""SELECT sum(support) AS sample_count, sum(tp) AS correct_count, count(*) AS num_classes, round(sum(tp) / sum(support), 6) AS top1_accuracy,
            round(avg({D_F1}) FILTER (support > 0), 6) AS macro_f1, round(avg(r) FILTER (support > 0), 6) AS balanced_accuracy FROM prf""",
        pred=D_PRED,
        cls=D_CLASS,
        prf=D_PRF,
    ),
)
def _(spark, sf):
    out = metrics.classification_summary(metrics.per_class(metrics.confusion(predictions(spark, sf))))
    return out.withColumns({c: F.round(c, 6) for c in ("top1_accuracy", "macro_f1", "balanced_accuracy")})


@query(
    "agg_mean_loss",
    """SELECT o_orderpriority AS run, round(sum(o_totalprice * n) / sum(n), 2) AS mean_loss, coalesce(sum(n), 0) AS loss_weight
       FROM (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN o_custkey % 64 END AS n FROM orders) GROUP BY 1""",
)
def _(spark, sf):
    """Orders as batches: partly shipped ones have no loss."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    loss = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    steps = orders.select(F.col("o_orderpriority").alias("run"), loss.alias("loss"), (F.col("o_custkey") % 64).alias("batch_size"))
    return metrics.mean_loss(steps, ["run"]).withColumn("mean_loss", F.round("mean_loss", 2))


@query(
    "agg_branch_blend",
    check(
        "seeds",
        """SELECT model, round(CASE WHEN a IS NULL AND b IS NULL THEN 0 WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE (0.3 * a + 0.7 * b) END, 6) AS blend,
           round(CASE WHEN a IS NULL AND b IS NULL THEN 0 WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE 0.8 * a + 0.2 * b END, 6) AS tradeoff FROM s""",
        s="SELECT model, max(metric) FILTER (seed = 0 AND model <> '5-LOW') AS a, max(metric) FILTER (seed = 1 AND model NOT IN ('1-URGENT')) AS b FROM seeds GROUP BY model",
    ),
)
def _(spark, sf):
    seeds = view(spark, sf, "seeds")
    wide = seeds.groupBy("model").agg(
        F.max(F.when((F.col("seed") == 0) & (F.col("model") != "5-LOW"), F.col("metric"))).alias("a"),
        F.max(F.when((F.col("seed") == 1) & (F.col("model") != "1-URGENT"), F.col("metric"))).alias("b"),
    )
    return wide.select("model", F.round(metrics.branch_blend("a", "b", 0.3, 0.7), 6).alias("blend"), F.round(metrics.tradeoff("a", "b"), 6).alias("tradeoff"))


D_STEPS = """SELECT l_returnflag AS stage, l_extendedprice / 10000 AS total_loss, l_discount AS macro_loss, l_tax AS micro_loss, l_quantity / 50 AS contrast_loss, l_discount * 2 AS genus_loss,
             l_linenumber AS macro_samples, cast(l_quantity AS int) % 4 AS micro_samples, cast(l_suppkey % 3 AS int) AS anchors, cast(l_partkey % 2 AS int) AS genus_pairs FROM {0}"""
LOSSES = ("total_loss", "macro_loss", "micro_loss", "contrast_loss", "genus_loss")
D_LOSS = """SELECT stage, round(sum(total_loss * (macro_samples + micro_samples)) / sum(macro_samples + micro_samples), 5) AS total_loss,
            round(sum(macro_loss * macro_samples) / sum(macro_samples), 5) AS macro_loss, round(sum(micro_loss * micro_samples) / sum(micro_samples), 5) AS micro_loss,
            round(sum(contrast_loss * greatest(1, anchors)) / sum(anchors), 5) AS contrast_loss, round(sum(genus_loss * greatest(1, genus_pairs)) / sum(genus_pairs), 5) AS genus_loss,
            sum(macro_samples) AS macro_samples, sum(micro_samples) AS micro_samples, sum(anchors) AS anchors, sum(genus_pairs) AS genus_pairs, count(*) AS steps FROM s GROUP BY stage"""


@query("agg_weighted_losses", check("", D_LOSS, s=D_STEPS.format("lineitem")))
def _(spark, sf):
    steps = spark.sql(D_STEPS.format(f"parquet.`{sf}/lineitem.parquet`"))
    return metrics.loss_means(steps, ["stage"]).withColumns({c: F.round(c, 5) for c in LOSSES})


@query(
    "agg_class_weights",
    check(
        "items",
        """SELECT s.species, coalesce(n, 0) AS n, round(CASE WHEN n > 0 THEN (SELECT sum(n) FROM c) / ((SELECT count(DISTINCT species) FROM items) * n) ELSE 0 END, 6) AS weight
           FROM (SELECT DISTINCT species FROM items) s LEFT JOIN c USING (species)""",
        c="SELECT species, count(*)::DOUBLE AS n FROM items WHERE protocol_group <> '' AND modality = 'macro' GROUP BY 1",
    ),
)
def _(spark, sf):
    items = view(spark, sf, "items").select("species", "protocol_group", "modality")
    counts = items.where((F.col("protocol_group") != "") & (F.col("modality") == "macro")).groupBy("species").agg(F.count(F.lit(1)).alias("n"))
    return metrics.class_weights(counts, items, "species").withColumn("weight", F.round("weight", 6))


@query("agg_inverse_freq", check("items", "SELECT species, count(*) AS n, round(1 / power(count(*), 0.5), 8) AS weight FROM items GROUP BY 1"))
def _(spark, sf):
    counts = view(spark, sf, "items").groupBy("species").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("weight", F.round(metrics.inverse_frequency("n", 0.5), 8))


D_BUCKET = """SELECT least(200, CASE WHEN up / 200.0::DOUBLE > c THEN up - 1 ELSE up END) AS bucket, correct FROM (
              SELECT c, correct, CASE WHEN (g + 1) / 200.0::DOUBLE <= c THEN g + 1 ELSE g END AS up FROM (SELECT confidence AS c, correct, cast(floor(confidence * 200) AS bigint) AS g FROM conf))"""
D_KEPT = """SELECT i / 200.0::DOUBLE AS tau, count(p.event_id) AS n_kept, coalesce(sum(p.correct), 0) AS n_correct
            FROM range(201) t(i) LEFT JOIN conf p ON p.confidence >= i / 200.0::DOUBLE GROUP BY i"""
D_CURVE = """SELECT tau, n_kept / (SELECT count(*) FROM conf) AS coverage, CASE WHEN n_kept > 0 THEN n_correct / n_kept END AS "precision",
             (SELECT count(*) FROM conf) - n_kept AS n_flagged FROM kept"""


@query("join_threshold", check("conf", "SELECT * FROM kept", kept=D_KEPT))
def _(spark, sf):
    return calibration.threshold_join(view(spark, sf, "conf"))


@query("agg_calibration", check("conf", 'SELECT tau, round(coverage, 8) AS coverage, round("precision", 8) AS "precision", n_flagged FROM curve', kept=D_KEPT, curve=D_CURVE))
def _(spark, sf):
    curve = calibration.calibrate(view(spark, sf, "conf"))
    return curve.withColumns({c: F.round(c, 8) for c in ("coverage", "precision")})


@query(
    "agg_calibration_scores",
    check(
        "scores",
        """SELECT i / 200.0::DOUBLE AS tau, count(c) AS n_kept, round(sum(ok) / nullif(count(c), 0), 8) AS "precision" FROM range(201) t(i) LEFT JOIN p ON c >= i / 200.0::DOUBLE GROUP BY i""",
        s="SELECT true_label, scores::DOUBLE[] AS s FROM scores",
        p="SELECT 1.0 / list_sum(list_transform(s, lambda x: exp(x - list_max(s)))) AS c, (list_position(s, list_max(s)) - 1 = true_label)::int AS ok FROM s",
    ),
)
def _(spark, sf):
    rows = predictions(spark, sf).withColumn("correct", (F.col("true_label") == F.col("pred_label")).cast("int"))
    curve = calibration.threshold_join(rows)
    right = F.when(F.col("n_kept") > 0, F.round(F.col("n_correct") / F.col("n_kept"), 8))
    return curve.select("tau", "n_kept", right.alias("precision"))


@query("win_cum_coverage", check("conf", "SELECT bucket, n, sum(n) OVER (ORDER BY bucket DESC) AS kept FROM (SELECT bucket, count(*) AS n FROM b GROUP BY 1)", b=D_BUCKET))
def _(spark, sf):
    counts = calibration.bucket_counts(view(spark, sf, "conf"))
    return calibration.cumulative_kept(counts).select("bucket", "n", F.col("_kept").alias("kept"))


TARGETS = [0.35, 0.42, 0.45, 0.99]


@query(
    "agg_threshold_pick",
    check(
        "conf",
        " UNION ALL ".join(
            f"""SELECT cast({t} AS double) AS target, min(tau) AS tau, round(arg_min(coverage, tau), 8) AS coverage, round(arg_min("precision", tau), 8) AS "precision", arg_min(n_flagged, tau) AS n_flagged,
                round(1 - arg_min(coverage, tau), 8) AS pct_flagged FROM curve WHERE "precision" >= {t}"""
            for t in TARGETS
        ),
        kept=D_KEPT,
        curve=D_CURVE,
    ),
)
def _(spark, sf):
    picks = calibration.pick_threshold(calibration.calibrate(view(spark, sf, "conf")), TARGETS)
    return picks.withColumns({c: F.round(c, 8) for c in ("coverage", "precision", "pct_flagged")})


@query(
    "agg_latency",
    check(
        "latency",
        """SELECT run, round(avg(latency_ms), 5) AS mean_ms, round(coalesce(stddev_samp(latency_ms), 0), 5) AS std_ms, round(quantile_cont(latency_ms, 0.5), 5) AS median_ms,
           round(quantile_cont(latency_ms, 0.05), 5) AS p05_ms, round(quantile_cont(latency_ms, 0.95), 5) AS p95_ms, min(latency_ms) AS min_ms, max(latency_ms) AS max_ms FROM latency GROUP BY run""",
    ),
)
def _(spark, sf):
    out = metrics.latency_summary(view(spark, sf, "latency"))
    return out.withColumns({c: F.round(c, 5) for c in ("mean_ms", "std_ms", "median_ms", "p05_ms", "p95_ms")})


MODELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "9-NEVER"]


@query(
    "agg_seed_summary",
    check(
        "seeds",
        """SELECT m.model, count(DISTINCT s.seed) AS n_seeds_completed, CASE WHEN count(s.metric) = 0 THEN 'NA' ELSE printf('%.2f', avg(s.metric) * 100) || ' ± ' || printf('%.2f', coalesce(stddev_samp(s.metric), 0) * 100) END AS metric,
           CASE WHEN count(DISTINCT s.seed) >= 3 THEN '' ELSE 'WARNING: ' || m.model || ' has only ' || count(DISTINCT s.seed) || '/3 seeds' END AS warning
           FROM (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '9-NEVER']) AS model) m
           LEFT JOIN (SELECT * FROM seeds WHERE NOT (model = '2-HIGH' AND seed = 1) AND NOT (model = '3-MEDIUM' AND seed > 0)) s ON s.model = m.model GROUP BY m.model""",
    ),
)
def _(spark, sf):
    rows = view(spark, sf, "seeds")
    rows = rows.where(~((F.col("model") == "2-HIGH") & (F.col("seed") == 1)) & ~((F.col("model") == "3-MEDIUM") & (F.col("seed") > 0)))
    return metrics.seed_summary(rows, spark.createDataFrame([(m,) for m in MODELS], "model string"), ["metric"])


@query(
    "join_run_metrics",
    check(
        "seeds",
        """SELECT s.model, s.seed, round(s.metric, 6) AS best_metric, round(a.v, 6) AS macro_top1, round(i.v, 6) AS micro_top1, round(l.v, 6) AS tradeoff_score, r.exact_r1 AS exact_r1
           FROM seeds s LEFT JOIN a USING (model, seed) LEFT JOIN i USING (model, seed) LEFT JOIN l USING (model, seed) LEFT JOIN r USING (model, seed)""",
        a="SELECT o_orderpriority AS model, o_custkey % 3 AS seed, avg(o_totalprice) / 600000 AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL",
        i="SELECT o_orderpriority AS model, o_custkey % 3 AS seed, avg(o_totalprice) / 600000 AS v FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 3 <> 1 GROUP BY ALL",
        l="SELECT o_orderpriority AS model, o_custkey % 3 AS seed, avg(o_totalprice) / 600000 AS v FROM orders GROUP BY ALL",
        r="SELECT o_orderpriority AS model, o_custkey % 3 AS seed, count(*) AS exact_r1 FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY ALL",
    ),
)
def _(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(
        F.col("o_orderpriority").alias("model"), (F.col("o_custkey") % 3).cast("int").alias("seed"), "o_orderstatus", (F.col("o_totalprice") / 600000).alias("v")
    )
    mean = lambda rows, name: rows.groupBy("model", "seed").agg(F.round(F.avg("v"), 6).alias(name))
    training = view(spark, sf, "seeds").withColumn("best_metric", F.round("metric", 6)).drop("metric")
    macro = mean(orders.where(F.col("o_orderstatus") == "F"), "top1")
    micro = mean(orders.where((F.col("o_orderstatus") == "O") & (F.col("seed") != 1)), "top1")
    found = orders.where(F.col("model") != "5-LOW").groupBy("model", "seed").agg(F.count(F.lit(1)).alias("exact_r1"))
    return metrics.join_run_metrics(training, macro, micro, mean(orders, "tradeoff_score"), found)


D_HIST = "SELECT run, row_number() OVER (PARTITION BY run ORDER BY ts, event_id) - 1 AS epoch, metric FROM runs"
D_BEST = """SELECT *, max(metric) OVER (PARTITION BY run ORDER BY epoch) AS best_metric,
            coalesce(metric > max(metric) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::int AS improved FROM hist"""
D_SINCE = "SELECT *, max(CASE WHEN improved = 1 THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS best_epoch FROM best"


def numbered(spark, sf):
    return history.number_epochs(view(spark, sf, "runs"), "run", ["ts", "event_id"]).select("run", "epoch", "metric")


@query("win_running_best", check("runs", "SELECT run, epoch, metric, improved, best_metric, best_epoch FROM since", hist=D_HIST, best=D_BEST, since=D_SINCE))
def _(spark, sf):
    return history.running_best(numbered(spark, sf))


@query(
    "win_early_stop",
    check(
        "runs",
        """SELECT run, arg_max(best_epoch, epoch) AS best_epoch, arg_max(best_metric, epoch) AS best_metric, min(epoch) FILTER (epoch - best_epoch >= 12) AS stop_epoch, max(n) AS epochs FROM (
           SELECT *, count(*) OVER (PARTITION BY run) AS n, coalesce(min(CASE WHEN epoch - best_epoch >= 12 THEN epoch END) OVER (PARTITION BY run), 1000000) AS stop FROM since) WHERE epoch <= stop GROUP BY run""",
        hist=D_HIST,
        best=D_BEST,
        since=D_SINCE,
    ),
)
def _(spark, sf):
    return history.early_stop(numbered(spark, sf), patience=12)


D_WALK = """SELECT * FROM (WITH RECURSIVE walk AS (
               SELECT run, epoch, metric, metric AS best, epoch AS best_epoch, true AS fresh FROM hist WHERE epoch = 0
               UNION ALL SELECT h.run, h.epoch, h.metric, CASE WHEN h.metric - w.best > 5.0 THEN h.metric ELSE w.best END,
                                CASE WHEN h.metric - w.best > 5.0 THEN h.epoch ELSE w.best_epoch END, h.metric - w.best > 5.0
               FROM walk w JOIN hist h ON h.run = w.run AND h.epoch = w.epoch + 1) SELECT * FROM walk)"""


@query("win_accepted_best", check("runs", "SELECT run, epoch, metric FROM walked WHERE fresh", hist=D_HIST, walked=D_WALK))
def _(spark, sf):
    """Bests under a minimum improvement of 5.0."""
    return history.accepted_bests(numbered(spark, sf), 5.0)


@query(
    "win_early_stop_delta",
    check(
        "runs",
        """SELECT run, arg_max(best_epoch, epoch) AS best_epoch, arg_max(best, epoch) AS best_metric, min(epoch) FILTER (epoch - best_epoch >= 12) AS stop_epoch, max(n) AS epochs FROM (
           SELECT *, count(*) OVER (PARTITION BY run) AS n, coalesce(min(CASE WHEN epoch - best_epoch >= 12 THEN epoch END) OVER (PARTITION BY run), 1000000) AS stop FROM walked) WHERE epoch <= stop GROUP BY run""",
        hist=D_HIST,
        walked=D_WALK,
    ),
)
def _(spark, sf):
    """Early stopping where an improvement must exceed 5.0."""
    return history.early_stop(numbered(spark, sf), patience=12, min_delta=5.0)


@query(
    "win_accepted_whole",
    check(
        "runs",
        """SELECT epoch, metric FROM walked WHERE fresh""",
        hist="SELECT 'all' AS run, row_number() OVER (ORDER BY ts, run, event_id) - 1 AS epoch, metric + (row_number() OVER (ORDER BY ts, run, event_id) - 1) / 4.0 AS metric FROM runs",
        walked=D_WALK,
    ),
)
def _(spark, sf):
    """All events as one rising run, which spreads over many pieces."""
    rows = view(spark, sf, "runs").withColumn("all", F.lit("all"))
    one = history.number_epochs(rows, "all", ["ts", "run", "event_id"]).select(F.col("all").alias("run"), "epoch", (F.col("metric") + F.col("epoch") / 4.0).alias("metric"))
    return history.accepted_bests(one, 5.0, piece=512).select("epoch", "metric")


@query(
    "agg_view_consistency",
    check(
        "emb",
        """SELECT modality, count(*) AS n, round(avg(1 - list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[]))), 6) AS distance FROM emb GROUP BY modality
           UNION ALL SELECT 'all', count(*), round(avg(1 - list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[]))), 6) FROM emb""",
    ),
)
def _(spark, sf):
    from benchweave.operators.pairs import view_consistency

    rows = view(spark, sf, "emb").withColumn("other", F.reverse("embedding"))
    return view_consistency(rows, "embedding", "other").withColumn("distance", F.round("distance", 6))
