"""Stand-in tables derived from the given ones; one text serves Spark and the DuckDB check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from benchweave.plans.dialect import DUCK, SparkDialect, h16

CATALOGUE_SEED = "cat"


def _names(d):
    code = d.number(f"substr({d.digest(CATALOGUE_SEED, 'p_name')}, 1, 8)")
    return f"""
    SELECT p_name, split_part(p_name, ' ', 1) AS g, {code} AS n
    FROM (SELECT DISTINCT p_name FROM {d.table('part')}) t0"""


def _catalogue(d):
    return """
    SELECT upper(substr(p_name, 1, 1)) || lower(substr(p_name, 2)) AS species,
           upper(substr(g, 1, 1)) || lower(substr(g, 2)) AS genus,
           CASE WHEN g = 'red' THEN 'Family ' || cast(n % 2 AS string) WHEN g = 'old' THEN '' ELSE 'Family ' || g END AS family,
           CASE n % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS protocol_group,
           CASE n % 3 WHEN 0 THEN 'exact_overlap' WHEN 1 THEN 'genus_overlap' ELSE 'macro_only' END AS overlap_type,
           CASE n % 3 WHEN 0 THEN 'P1,P2,P3' WHEN 1 THEN 'P2,P3' ELSE 'P3' END AS protocol_usage,
           cast(n % 50 AS int) AS group_order, n AS position
    FROM names WHERE n % 8 <> 0 AND g <> 'small'"""


def _corrections(d):
    """Every record has a correction for its name without the last letter."""
    return "SELECT substr(species, 1, length(species) - 1) AS raw_name, species AS corrected_name FROM catalogue"


def _raw_names(d):
    return f"""
    SELECT p_partkey, p_name, p_size,
           CASE p_partkey % 8 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, ' ', '_')
                WHEN 2 THEN '  ' || replace(p_name, ' ', '  ') || ' .'
                WHEN 3 THEN substr(p_name, 1, length(p_name) - 1)
                WHEN 7 THEN substr(p_name, 1, 2) || substr(p_name, 4) ELSE p_name END AS raw_name
    FROM {d.table('part')}"""


def _lines(d):
    ident = ", ".join(f"cast({c} AS string)" for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return f"""
    SELECT concat_ws('-', {ident}, {d.day('l_shipdate')}) AS item_id,
           l_orderkey, l_linenumber, l_partkey, l_suppkey,
           CASE WHEN l_linestatus = 'F' THEN 'macro' ELSE 'micro' END AS modality,
           CASE l_returnflag WHEN 'A' THEN 'Phase1' WHEN 'R' THEN 'Phase2' ELSE '' END AS phase
    FROM {d.table('lineitem')}"""


def _items(d):
    return """
    SELECT l.item_id, '/data/' || l.modality || '/' || l.item_id || '.png' AS image_path,
           l.item_id || '.png' AS image_rel_path, 'bench_' || l.modality AS dataset_name, l.modality,
           'section' AS view, upper(substr(n.p_name, 1, 1)) || substr(n.p_name, 2) AS species,
           upper(substr(n.p_name, 1, 1)) || substr(split_part(n.p_name, ' ', 1), 2) AS genus,
           coalesce(c.family, '') AS family,
           CASE WHEN l.l_suppkey % 10 = 0 THEN 'NA' ELSE cast(l.l_suppkey AS string) END AS specimen_id,
           l.item_id AS source_id, l.phase, n.raw_name AS raw_species_name,
           upper(substr(n.p_name, 1, 1)) || substr(n.p_name, 2) AS normalized_species_name,
           coalesce(c.protocol_group, '') AS protocol_group, coalesce(c.overlap_type, '') AS overlap_type,
           coalesce(c.protocol_usage, '') AS protocol_usage, coalesce(c.species, '') AS matched_species_name,
           CASE WHEN c.species IS NULL THEN 'unmatched' ELSE 'exact_species_match' END AS taxonomy_match_status,
           '' AS taxonomy_suggestions
    FROM lines l JOIN raw_names n ON l.l_partkey = n.p_partkey
    LEFT JOIN catalogue c ON c.species = upper(substr(n.p_name, 1, 1)) || substr(n.p_name, 2)"""


def _files(d):
    return """
    SELECT l.modality, l.item_id, l.phase, n.raw_name,
           CASE WHEN l.modality = 'macro' THEN
             CASE WHEN l.phase = '' THEN 'extra/' ELSE l.phase || '/' END ||
             CASE WHEN l.l_suppkey % 7 = 0 THEN n.raw_name ELSE cast(n.p_size AS string) || '. ' || n.raw_name END ||
             CASE WHEN l.l_suppkey % 3 = 0 THEN '/' ELSE '/' || cast(l.l_suppkey AS string) || '. box/part/' END ||
             CASE WHEN l.l_suppkey % 2 = 0 THEN 'AB' || cast(10 + l.l_suppkey AS string) || '_' ELSE '' END || l.item_id || '.PNG'
           ELSE n.raw_name || '/' || CASE WHEN l.l_suppkey % 3 = 0 THEN '' ELSE cast(l.l_suppkey AS string) || '/' END ||
             l.item_id || '.tif' END AS rel_path
    FROM lines l JOIN raw_names n ON l.l_partkey = n.p_partkey"""


def _log(d):
    return """
    SELECT CASE WHEN l.l_suppkey % 4 = 0 THEN '/data/macro/' || f.rel_path ELSE '/old/macro/' || f.rel_path END AS processed_path,
           'Logged' AS phase, '' AS raw_species_folder_name,
           CASE WHEN l.l_suppkey % 5 = 0 THEN '' ELSE n.p_name END AS raw_species_name,
           CASE WHEN l.l_suppkey % 5 < 2 THEN n.p_name ELSE '' END AS corrected_species_name
    FROM files f JOIN lines l ON f.item_id = l.item_id AND l.modality = 'macro'
    JOIN raw_names n ON l.l_partkey = n.p_partkey
    WHERE f.modality = 'macro' AND l.l_linenumber % 3 = 0"""


def _available(d):
    return f"SELECT doc_id, n_chars AS bytes FROM {d.table('documents')}"


def _required(d):
    return f"""
    SELECT doc_id, quality AS label FROM {d.table('labels')}
    UNION ALL SELECT doc_id + 10000000, quality FROM {d.table('labels')} WHERE doc_id % 7 = 0"""


def _run_log(d):
    return f"""
    SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'skipped_exists' WHEN 1 THEN 'failed' ELSE 'processed' END AS status,
           CASE WHEN page_id % 2 = 0 THEN 'Phase1' ELSE 'Phase2' END AS phase, cast(page_id % 3 = 0 AS int) AS in_catalogue,
           CASE page_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE '' END AS protocol_group,
           cast(length(html) AS bigint) AS original_bytes,
           CASE WHEN page_id % 5 <> 1 THEN cast(length(url) AS bigint) END AS new_bytes
    FROM {d.table('pages')}"""


def _emb(d):
    return f"""
    SELECT 'v' || cast(vec_id AS string) AS id, vec_id, CASE WHEN vec_id % 2 = 0 THEN 'macro' ELSE 'micro' END AS modality,
           'Genus' || cast(cast(floor(label / 2) AS bigint) AS string) || ' s' || cast(label AS string) AS species,
           'Genus' || cast(cast(floor(label / 2) AS bigint) AS string) AS genus,
           embedding, cast(floor(vec_id / 32) AS bigint) AS batch_id
    FROM {d.table('embeddings')}"""


def _scores(d):
    return f"SELECT vec_id, label AS true_label, {d.fold('embedding', 10)} AS scores FROM {d.table('embeddings')}"


def _conf(d):
    return f"""
    SELECT event_id, least(value / 500.0, 1.0) AS confidence,
           CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END AS correct
    FROM {d.table('events')}"""


def _latency(d):
    return f"SELECT event_type AS run, value AS latency_ms FROM {d.table('events')}"


def _seeds(d):
    return f"""
    SELECT o_orderpriority AS model, cast(o_custkey % 3 AS int) AS seed, avg(o_totalprice) / 1000000.0 AS metric
    FROM {d.table('orders')} GROUP BY o_orderpriority, cast(o_custkey % 3 AS int)"""


def _runs(d):
    return f"SELECT user_id AS run, ts, event_id, value AS metric FROM {d.table('events')}"


def _dims(d):
    return f"""
    SELECT p_partkey, cast(p_size * 37 + 1 AS bigint) AS width, cast(floor(p_retailprice) AS bigint) AS height
    FROM {d.table('part')}"""


VIEWS = {
    "names": ((), _names),
    "catalogue": (("names",), _catalogue),
    "corrections": (("catalogue",), _corrections),
    "raw_names": ((), _raw_names),
    "lines": ((), _lines),
    "items": (("lines", "raw_names", "catalogue"), _items),
    "files": (("lines", "raw_names"), _files),
    "log": (("files", "lines", "raw_names"), _log),
    "available": ((), _available),
    "required": ((), _required),
    "run_log": ((), _run_log),
    "emb": ((), _emb),
    "scores": ((), _scores),
    "conf": ((), _conf),
    "latency": ((), _latency),
    "seeds": ((), _seeds),
    "runs": ((), _runs),
    "dims": ((), _dims),
}


def _closure(wanted) -> list[str]:
    out: list[str] = []

    def add(name):
        for dep in VIEWS[name][0]:
            add(dep)
        if name not in out:
            out.append(name)

    for name in wanted:
        add(name)
    return out


def chain(d: SparkDialect, *wanted: str) -> str:
    """``WITH`` list of the wanted views and everything they build on."""
    return "WITH " + ", ".join(f"{name} AS ({VIEWS[name][1](d)})" for name in _closure(wanted))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(f"{chain(SparkDialect(sf_dir), name)} SELECT * FROM {name}")


def check(views: str, body: str, **extra: str) -> str:
    """DuckDB text: the named views, then named extra steps, then the final select."""
    head = chain(DUCK, *views.split()) if views else ""
    steps = ", ".join(f"{name} AS ({text})" for name, text in extra.items())
    if steps:
        head = f"{head}, {steps}" if head else f"WITH {steps}"
    return f"{head} {body}"
