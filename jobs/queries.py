"""The jobs as registered queries: each runs its job twice into one new folder and returns what stands there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from insertframe.plans.io_queries import _scratch
from insertframe.plans.queries import ANCHOR, CONSTANT, LEADER, NT, OH, _sql_gc_windows, _sql_hamming, _sql_translate
from jobs import order_release, registry_intake
from jobs.common import default_config


def job1_order_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{_scratch(spark, keep=True)}/order-release"
    for _ in range(2):
        order_release.run(spark, default_config("order_release"), sf_dir, "documents", out)
    columns = ["record_idx", "ab_id", "chain_class", "kind", "severity", "core_len", "n_chains", "n_failed", "first_failed", "released", "sent_length"]
    return order_release.written(spark, out).select(*columns)


def job2_registry_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{_scratch(spark, keep=True)}/registry-intake"
    for _ in range(2):
        registry_intake.run(spark, default_config("registry_intake"), f"{sf_dir}/documents.parque[t]", out, f"{out}/checkpoint")  # a pattern: a stream takes no single file's path
    columns = ["id", "idx", "ab_id", "chain_class", "sha256", "n", "kind", "gc", "max_gc", "protein_length", "existing_id", "n_entries", "shortest", "longest"]
    return registry_intake.written(spark, out).select(*columns)


QUERIES = {"job1_order_release": job1_order_release, "job2_registry_intake": job2_registry_intake}

_CORE = f"regexp_replace({NT}, '(.)', 'C\\1C', 'g')"
_ORDER = f"""WITH c AS (SELECT doc_id, CASE WHEN doc_id % 10 = 6 AND length(k) > 0 THEN substr(k, 1, length(k) - 1) ELSE k END AS core FROM (SELECT doc_id, {_CORE} AS k FROM documents)),
n AS (SELECT doc_id, core, 'AB' || doc_id // 2 AS ab_id, CASE WHEN doc_id % 2 = 0 THEN 'heavy' WHEN doc_id % 4 = 1 THEN 'kappa' ELSE 'lambda' END AS chain_class,
  core || CASE WHEN doc_id % 4 = 3 THEN '{OH['IGL'][1]}' ELSE '{OH['IGK'][1]}' END AS f FROM c),
a AS (SELECT *, {_sql_translate('core')} AS aa, {_sql_translate(f"'{LEADER}' || core || '{CONSTANT}{'ACGTTGCAAC' * 30}'")} AS orf,
  doc_id % 10 = 7 AND {_sql_hamming('substr(f, 1, 20)', "'" + OH['IGK'][0] + "'", 20)} > 1 AS bare FROM n),
v AS (SELECT *, CASE WHEN doc_id % 10 = 4 THEN 'OVERHANG_WRONG_LOCUS' WHEN bare THEN 'OVERHANG_MISSING'
  WHEN chain_class = 'heavy' AND split_part(orf, '*', 1) NOT LIKE '%{ANCHOR}%' THEN 'FRAMESHIFT_AT_JUNCTION'
  WHEN chain_class <> 'heavy' AND (length(core) % 3 <> 0 OR contains(aa, '*')) THEN 'FRAMESHIFT_AT_JUNCTION'
  WHEN doc_id % 6 = 0 THEN 'PASS' ELSE 'NO_GROUND_TRUTH' END AS kind FROM a),
g AS (SELECT ab_id, count(*) AS n_chains, count(*) FILTER (kind NOT IN ('PASS', 'NO_GROUND_TRUTH')) AS n_failed,
  arg_min('AB' || doc_id // 2 || '_' || chain_class || ': ' || kind, doc_id) FILTER (kind NOT IN ('PASS', 'NO_GROUND_TRUTH')) AS first_failed FROM v GROUP BY ab_id)
SELECT doc_id AS record_idx, ab_id, chain_class, kind, CASE kind WHEN 'PASS' THEN 'Pass' WHEN 'NO_GROUND_TRUTH' THEN 'Advisory' ELSE 'Fail' END AS severity,
  CASE WHEN kind NOT LIKE 'OVERHANG%' THEN length(core)::int END AS core_len, n_chains, n_failed, first_failed, n_failed = 0 AND n_chains >= 2 AS released,
  CASE WHEN n_failed = 0 AND n_chains >= 2 THEN (length(core) + 40)::int END AS sent_length FROM v JOIN g USING (ab_id)"""

_FRAME = [f"length(split_part({_sql_translate(f'substr(s, {i + 1})')}, '*', 1))" for i in range(3)]
_REGISTRY = f"""WITH d AS (SELECT 'C' || length(coalesce(text, '')) % 97 AS ab_id, CASE WHEN doc_id % 2 = 0 THEN 'heavy' ELSE 'light' END AS chain_class, doc_id AS idx, {NT} AS s FROM documents),
h AS (SELECT *, ab_id || '_' || chain_class AS id, sha256(s) AS sha256 FROM d),
f AS (SELECT *, first_value(id) OVER w AS first_id, row_number() OVER w AS r FROM h WINDOW w AS (PARTITION BY sha256 ORDER BY idx, id)),
e AS (SELECT *, length(s) AS n FROM f WHERE r = 1 OR id <> first_id)
SELECT id, idx, ab_id, chain_class, sha256, n, CASE WHEN n > 0 AND 10 * length(regexp_replace(s, '[^ACGTUN]', '', 'g')) >= 9 * n THEN 'nt' ELSE 'aa' END AS kind,
  CASE WHEN n = 0 THEN 0.0::double ELSE round(length(regexp_replace(s, '[^GC]', '', 'g')) / n::double, 6) END AS gc, round(({_sql_gc_windows('s', 60)})::double, 6) AS max_gc,
  greatest({', '.join(_FRAME)})::bigint AS protein_length, CASE WHEN id <> first_id THEN first_id END AS existing_id,
  count(*) OVER g AS n_entries, min(n) OVER g AS shortest, max(n) OVER g AS longest FROM e WINDOW g AS (PARTITION BY ab_id, chain_class)"""

ORACLES = {"job1_order_release": _ORDER, "job2_registry_intake": _REGISTRY}
