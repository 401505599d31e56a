"""Cosine retrieval, hits, reports and resampled intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from benchweave.operators import retrieval
from benchweave.plans.dialect import unit
from benchweave.plans.registry import query
from benchweave.plans.views import check, view

SEED = 42


def direction(a: str, b: str, p: str, k: int = 5) -> dict[str, str]:
    """Check steps: all similarities of one direction, the best k, and scored queries as ``{p}scored``."""
    return {
        f"{p}sim": f"""SELECT q.id AS q_id, q.species AS qs, q.genus AS qg, g.id AS g_id, g.species AS gs, g.genus AS gg,
                       round(list_cosine_similarity(q.embedding::DOUBLE[], g.embedding::DOUBLE[]), 9) AS similarity
                       FROM emb q, emb g WHERE q.modality = '{a}' AND g.modality = '{b}' AND q.id <> g.id""",
        f"{p}top": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY similarity DESC, g_id) AS rank FROM {p}sim) WHERE rank <= {k}",
        f"{p}hit": f"""SELECT q_id, max((qs = gs)::int) FILTER (rank = 1) AS exact_r1, max((qs = gs)::int) AS exact_rk, avg((qs = gs)::int) AS exact_purity,
                       max((qg = gg)::int) FILTER (rank = 1) AS genus_r1, max((qg = gg)::int) AS genus_rk, avg((qg = gg)::int) AS genus_purity FROM {p}top GROUP BY q_id""",
        f"{p}scored": f"""SELECT e.id, e.species, e.genus, (e.species IN (SELECT species FROM emb WHERE modality = '{b}'))::int AS eligible_exact,
                          (e.genus IN (SELECT genus FROM emb WHERE modality = '{b}'))::int AS eligible_genus, h.* EXCLUDE (q_id)
                          FROM emb e JOIN {p}hit h ON h.q_id = e.id WHERE e.modality = '{a}'""",
    }


M2U, U2M = direction("macro", "micro", "f_"), direction("micro", "macro", "b_")


def sides(spark, sf):
    return retrieval.split_modalities(view(spark, sf, "emb"))


def scored(spark, sf):
    macro, micro = sides(spark, sf)
    return retrieval.score_queries(macro, micro)


@query("join_similarity_topk", check("emb", "SELECT q_id, g_id, rank, round(similarity, 6) AS similarity FROM f_top", **M2U))
def _(spark, sf):
    macro, micro = sides(spark, sf)
    return retrieval.top_k(macro, micro).select("q_id", "g_id", F.col("rank").cast("bigint").alias("rank"), F.round("similarity", 6).alias("similarity"))


@query("win_topk_gallery", check("emb", "SELECT q_id, g_id, gs AS g_species, rank FROM b_top WHERE rank <= 3", **U2M))
def _(spark, sf):
    macro, micro = sides(spark, sf)
    return retrieval.top_k(micro, macro, k=3).select("q_id", "g_id", "g_species", F.col("rank").cast("bigint").alias("rank"))


@query(
    "agg_recall_at_k",
    check(
        "emb",
        """SELECT count(*) AS queries, sum(eligible_exact) AS eligible_exact, round(avg(exact_r1) FILTER (eligible_exact = 1), 8) AS exact_r1, round(avg(exact_rk) FILTER (eligible_exact = 1), 8) AS exact_r5,
           round(avg(genus_r1) FILTER (eligible_genus = 1), 8) AS genus_r1, round(avg(genus_rk) FILTER (eligible_genus = 1), 8) AS genus_r5 FROM f_scored""",
        **M2U,
    ),
)
def _(spark, sf):
    rows = scored(spark, sf)
    mean = lambda c, level: F.round(F.avg(F.when(F.col(f"eligible_{level}") == 1, F.col(c).cast("double"))), 8)
    return rows.agg(
        F.count(F.lit(1)).alias("queries"),
        F.sum("eligible_exact").alias("eligible_exact"),
        mean("exact_r1", "exact").alias("exact_r1"),
        mean("exact_rk", "exact").alias("exact_r5"),
        mean("genus_r1", "genus").alias("genus_r1"),
        mean("genus_rk", "genus").alias("genus_r5"),
    )


@query("agg_purity_at_k", check("emb", "SELECT round(avg(exact_purity) FILTER (eligible_exact = 1), 8) AS exact_purity, round(avg(genus_purity) FILTER (eligible_genus = 1), 8) AS genus_purity FROM f_scored", **M2U))
def _(spark, sf):
    rows = scored(spark, sf)
    mean = lambda level: F.round(F.avg(F.when(F.col(f"eligible_{level}") == 1, F.col(f"{level}_purity"))), 8).alias(f"{level}_purity")
    return rows.agg(mean("exact"), mean("genus"))


def _report(p: str, label: str, gallery: str) -> str:
    cols = []
    for level in ("exact", "genus"):
        cols.append(f"sum(eligible_{level}) AS eligible_{level}_queries")
        for source, name in (("r1", "recall_at_1"), ("rk", "recall_at_5"), ("r1", "top1_purity"), ("purity", "top5_purity")):
            cols.append(f"round(avg({level}_{source}) FILTER (eligible_{level} = 1), 8) AS {level}_{name}")
    return f"SELECT '{label}' AS direction, count(*) AS query_count, (SELECT count(*) FROM emb WHERE modality = '{gallery}') AS gallery_count, {', '.join(cols)} FROM {p}scored"


@query("agg_retrieval_report", check("emb", _report("f_", "macro_to_micro", "micro") + " UNION ALL " + _report("b_", "micro_to_macro", "macro"), **M2U, **U2M))
def _(spark, sf):
    report = retrieval.retrieval_report(view(spark, sf, "emb"))
    rates = [c for c in report.columns if "recall" in c or "purity" in c]
    return report.withColumns({c: F.round(c, 8) for c in rates})


@query(
    "agg_recall_by_entity",
    check("emb", "SELECT species, count(*) AS queries, round(avg(exact_r1), 8) AS recall_at_1, (avg(exact_r1) = 0)::int AS never_found FROM f_scored WHERE eligible_exact = 1 GROUP BY 1", **M2U),
)
def _(spark, sf):
    return retrieval.recall_by_entity(scored(spark, sf)).withColumn("recall_at_1", F.round("recall_at_1", 8))


RESAMPLES = 200


@query(
    "agg_bootstrap_ci",
    check(
        "emb",
        """SELECT h.task, h.n AS queries, round(h.h / h.n, 8) AS point_estimate, round(avg(v), 8) AS mean, round(stddev_samp(v), 8) AS std, round(quantile_cont(v, 0.025), 8) AS ci_lower,
           round(quantile_cont(v, 0.975), 8) AS ci_upper FROM val JOIN h ON h.task = val.task GROUP BY h.task, h.n, h.h""",
        **M2U,
        rows=f"""SELECT 'M2m_exact_R1' AS task, {SEED} AS seed, id, exact_r1 AS hit FROM f_scored WHERE eligible_exact = 1
                 UNION ALL SELECT 'M2m_exact_R5', {SEED + 10003}, id, exact_rk FROM f_scored WHERE eligible_exact = 1""",
        h="SELECT task, count(*) AS n, sum(hit) AS h FROM rows GROUP BY task",
        val=f"""SELECT r.task, b, sum((floor({unit('', 'b', 'id').replace("concat_ws('|', '', ", "concat_ws('|', cast(seed AS varchar), ")} * n) < h)::int) / max(n) AS v
                FROM rows r JOIN h USING (task), range({RESAMPLES}) t(b) GROUP BY r.task, b""",
    ),
)
def _(spark, sf):
    rows = retrieval.hit_rows(scored(spark, sf), "M2m", "exact", SEED)
    out = retrieval.bootstrap_ci(rows, ["task", "seed"], RESAMPLES, "seed").drop("seed", "ci_width")
    return out.withColumns({c: F.round(c, 8) for c in ("point_estimate", "mean", "std", "ci_lower", "ci_upper")})


@query("agg_bootstrap_suite")
def _(spark, sf):
    """Every task of a data set with its own seed; tests check it against single-task runs."""
    return retrieval.bootstrap_suite(view(spark, sf, "emb"), RESAMPLES)


@query(
    "src_validate_bundle",
    """SELECT modality, count(*) AS rows, count(*) FILTER (v IS NULL) AS missing, min(len(v)) AS min_dim, max(len(v)) AS max_dim, cast(0 AS bigint) AS bad_values FROM (
       SELECT CASE WHEN vec_id % 2 = 0 THEN 'macro' ELSE 'micro' END AS modality, CASE WHEN vec_id % 50 = 0 THEN NULL WHEN vec_id % 51 = 0 THEN embedding[1:8] ELSE embedding END AS v FROM embeddings) GROUP BY 1""",
)
def _(spark, sf):
    broken = F.when(F.col("vec_id") % 50 == 0, None).when(F.col("vec_id") % 51 == 0, F.slice("embedding", 1, 8)).otherwise(F.col("embedding"))
    return retrieval.validate_vectors(view(spark, sf, "emb").withColumn("embedding", broken))


@query(
    "src_embed_columns",
    check("emb", "SELECT id, modality, species, genus, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM emb"),
)
def _(spark, sf):
    from benchweave.sources.embeddings import from_parallel_arrays

    emb = view(spark, sf, "emb").withColumn("piece", (F.col("vec_id") / 64).cast("bigint"))
    aggs = []
    for m in ("macro", "micro"):
        rows = F.array_sort(F.collect_list(F.when(F.col("modality") == m, F.struct("vec_id", "id", "species", "genus", "embedding"))))
        aggs += [rows.getField(f).alias(f"{m}_{name}") for f, name in (("embedding", "embeddings"), ("species", "labels"), ("genus", "genus"), ("id", "ids"))]
    packed = emb.groupBy("piece").agg(*aggs).drop("piece")
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda acc, x: acc + x)
    return from_parallel_arrays(packed).select("id", "modality", "species", "genus", F.round(total, 5).alias("total"))


DIMENSIONS = 64


@query(
    "src_embed_wide",
    check("emb", "SELECT id, modality, species, genus, cast(len(embedding) AS bigint) AS dim, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM emb"),
)
def _(spark, sf):
    from benchweave.sources.embeddings import from_wide

    cols = [F.get("embedding", F.lit(i)).alias(f"embedding_{i}") for i in range(DIMENSIONS)]
    wide = view(spark, sf, "emb").select("modality", "species", F.lit("").alias("genus"), F.col("id").alias("image_path"), *cols)
    rows = retrieval.with_genus(from_wide(wide))
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda acc, x: acc + x)
    return rows.select(F.col("image_path").alias("id"), "modality", "species", "genus", F.size("embedding").cast("bigint").alias("dim"), F.round(total, 5).alias("total"))
