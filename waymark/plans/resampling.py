"""Split and bootstrap queries. Hash picks are written in SQL too, so results agree row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators import bootstrap, metrics, splits
from waymark.plans.base import PREDICTIONS, predictions, ranking_sql, rounded, table

_SEED, _DRAWS = 2027, 40


def _hash_sql(prefix: str, *parts: str) -> str:
    return f"CAST('0x' || substr(sha256('{prefix}|' || {' || chr(124) || '.join(parts)}), 1, 15) AS BIGINT)"


def hash_rank_folds(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source")
    return splits.hash_folds(rows, "source", 5, 11, "outer")


def cv_manifest(spark, sf):
    rows = splits.hash_folds(table(spark, sf, "documents").select("doc_id", "source"), "source", 3, 11, "outer")
    return splits.cv_manifest(rows, 3).groupBy("outer_fold", "role").agg(F.count("*").alias("n"), F.sum("doc_id").alias("id_sum"))


FOLDS_SQL = f"SELECT doc_id, source, CAST({_hash_sql('11|outer', 'source')} % 5 AS INT) AS fold FROM documents"
CV_SQL = f"""WITH f AS (SELECT doc_id, CAST({_hash_sql('11|outer', 'source')} % 3 AS INT) AS fold FROM documents)
SELECT o.outer_fold, CASE WHEN fold = o.outer_fold THEN 'validation' ELSE 'train' END AS role, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS id_sum
FROM f, (SELECT unnest([0, 1, 2]) AS outer_fold) o GROUP BY ALL"""


def fold_validity(spark, sf):
    labelled = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    rows = splits.hash_folds(labelled, "source", 3, 11, "outer")
    return splits.fold_validity(splits.cv_manifest(rows, 3), "doc_id", "quality", 3)


VALIDITY_SQL = f"""WITH f AS (SELECT doc_id, quality, CAST({_hash_sql('11|outer', 'source')} % 3 AS INT) AS fold FROM labels JOIN documents USING (doc_id)),
m AS (SELECT doc_id, quality, o.outer_fold, fold = o.outer_fold AS v FROM f, (SELECT unnest([0, 1, 2]) AS outer_fold) o),
k AS (SELECT count(*) AS n, count(*) FILTER (v) AS vs FROM m GROUP BY doc_id), s AS (SELECT count(DISTINCT quality) AS classes FROM m GROUP BY outer_fold, v)
SELECT (SELECT count(*) FILTER (n <> 3) FROM k) AS incomplete_keys, (SELECT count(*) FILTER (vs <> 1) FROM k) AS not_once_validated, (SELECT count(*) FILTER (classes < 2) FROM s) AS one_class_sides"""


def logo_manifest(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "lang")
    return splits.leave_one_out(rows, "lang")


LOGO_SQL = """SELECT d.doc_id, d.lang, h.lang AS held_out_group, CASE WHEN d.lang = h.lang THEN 'validation' ELSE 'train' END AS role
FROM documents d CROSS JOIN (SELECT DISTINCT lang FROM documents) h"""


def grouped_stratified_greedy(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id")
    return splits.grouped_stratified(rows.select("doc_id", "lang", "source", "quality"), "lang", "source", "quality", (4, 3, 2), 5)


def _drawn(spark, sf):
    scored = predictions(spark, sf).where("method IN ('B2', 'B4') AND target = 'quality'")
    return scored, bootstrap.draws(scored, "domain", "group_key", _DRAWS, _SEED)


_DRAWN = f"""own AS (SELECT * FROM pred WHERE method IN ('B2', 'B4') AND target = 'quality'),
listed AS (SELECT domain, group_key, row_number() OVER (PARTITION BY domain ORDER BY group_key) - 1 AS at FROM (SELECT DISTINCT domain, group_key FROM own)),
sizes AS (SELECT domain, CAST(count(*) AS INT) AS k FROM listed GROUP BY domain),
slots AS (SELECT domain, k, bootstrap_id, CAST(unnest(range(0, k)) AS INT) AS draw_position FROM sizes, (SELECT CAST(unnest(range(0, {_DRAWS})) AS INT) AS bootstrap_id)),
picked AS (SELECT *, {_hash_sql(f'{_SEED}|draw', 'domain', 'bootstrap_id', 'draw_position')} % {1 << 30} % k AS at FROM slots),
drawn AS (SELECT p.domain, bootstrap_id, draw_position, group_key, CAST(row_number() OVER (PARTITION BY p.domain, bootstrap_id, group_key ORDER BY draw_position) - 1 AS INT) AS occurrence
    FROM picked p JOIN listed l ON p.domain = l.domain AND p.at = l.at),
expanded AS (SELECT d.bootstrap_id, o.* FROM drawn d JOIN own o ON d.domain = o.domain AND d.group_key = o.group_key)"""


def bootstrap_draws(spark, sf):
    return _drawn(spark, sf)[1]


def cluster_expansion(spark, sf):
    scored, drawn = _drawn(spark, sf)
    rows = bootstrap.expanded(drawn, scored.where("method = 'B2'").select("domain", "group_key", "unit", "label"), "domain", "group_key")
    return rows.groupBy("domain", "bootstrap_id").agg(F.count("*").alias("rows"), F.sum("label").alias("positives"), F.sum("unit").alias("unit_sum"))


EXPANSION_SQL = f"""WITH {PREDICTIONS}, {_DRAWN} SELECT domain, bootstrap_id, count(*) AS rows, CAST(sum(label) AS BIGINT) AS positives, CAST(sum(unit) AS BIGINT) AS unit_sum
FROM expanded WHERE method = 'B2' GROUP BY domain, bootstrap_id"""


def _resampled(spark, sf):
    scored, drawn = _drawn(spark, sf)
    return bootstrap.resampled_ranking(drawn, scored, "domain", "group_key", "method")


def bootstrap_metrics(spark, sf):
    found = _resampled(spark, sf)
    return found.select("domain", "method", "bootstrap_id", "n", "positives", *[rounded(F.col(c)).alias(c) for c in ("average_precision", "ap_lift", "roc_auc")])


_RESAMPLED = f"{PREDICTIONS}, {_DRAWN}, {ranking_sql('domain, method, bootstrap_id', 'expanded', 'rs')}"
METRICS_SQL = f"""WITH {_RESAMPLED} SELECT domain, method, bootstrap_id, n, positives, round(average_precision, 9) + 0.0 AS average_precision,
    round(ap_lift, 9) + 0.0 AS ap_lift, round(roc_auc, 9) + 0.0 AS roc_auc FROM rs"""


def _interval_columns(df, *keys):
    return df.select(*keys, *[rounded(F.col(c)).alias(c) for c in ("median", "low", "high", "width")], "valid", "invalid", rounded(F.col("valid_fraction")).alias("valid_fraction"))


def _interval_sql(value: str, keys: str, source: str) -> str:
    q = {p: f"quantile_cont({value}, {p})" for p in (0.5, 0.025, 0.975)}
    return f"""SELECT {keys}, round({q[0.5]}, 9) + 0.0 AS median, round({q[0.025]}, 9) + 0.0 AS low, round({q[0.975]}, 9) + 0.0 AS high,
    round({q[0.975]} - {q[0.025]}, 9) + 0.0 AS width, count({value}) AS valid, count(*) - count({value}) AS invalid, round(count({value}) / count(*)::DOUBLE, 9) AS valid_fraction
    FROM {source} GROUP BY {keys}"""


def bootstrap_ci(spark, sf):
    return _interval_columns(bootstrap.intervals(_resampled(spark, sf), "ap_lift", "domain", "method"), "domain", "method")


def macro_bootstrap_min2(spark, sf):
    macro = bootstrap.macro_draws(_resampled(spark, sf), "ap_lift", "method", "bootstrap_id", least=2)
    return _interval_columns(bootstrap.intervals(macro, "ap_lift", "method"), "method")


MACRO_SQL = f"""WITH {_RESAMPLED}, m AS (SELECT method, bootstrap_id, CASE WHEN count(ap_lift) >= 2 THEN avg(ap_lift) END AS ap_lift FROM rs GROUP BY method, bootstrap_id)
{_interval_sql("ap_lift", "method", "m")}"""


def pooled_bootstrap(spark, sf):
    """One stream of draws over all domains: metrics of what all of them drew together."""
    scored, drawn = _drawn(spark, sf)
    counts = scored.groupBy("domain", "group_key", "method", "score", "label").agg(F.count("*").alias("_c"))
    weighted = counts.join(bootstrap.multiplicities(drawn, "domain", "group_key"), ["domain", "group_key"]).withColumn("_w", F.col("_c") * F.col("times"))
    found = metrics.ranking(weighted, "method", "bootstrap_id", weight="_w")
    return found.select("method", "bootstrap_id", "n", rounded(F.col("ap_lift")).alias("ap_lift"))


POOLED_SQL = f"""WITH {PREDICTIONS}, {_DRAWN}, {ranking_sql('method, bootstrap_id', 'expanded', 'rs')} SELECT method, bootstrap_id, n, round(ap_lift, 9) + 0.0 AS ap_lift FROM rs"""


def paired_delta_ci(spark, sf):
    delta = bootstrap.paired_delta(_resampled(spark, sf), "ap_lift", "method", "B4", "B2", "domain", "bootstrap_id")
    found = bootstrap.intervals(delta, "delta", "domain")
    grade = metrics.evidence_grade(F.col("low"), F.col("median"), F.col("valid_fraction"))
    return _interval_columns(found, "domain").join(found.select("domain", grade.alias("grade")), "domain")


PAIRED_SQL = f"""WITH {_RESAMPLED}, d AS (SELECT domain, bootstrap_id, max(ap_lift) FILTER (method = 'B4') - max(ap_lift) FILTER (method = 'B2') AS delta FROM rs GROUP BY domain, bootstrap_id),
i AS ({_interval_sql("delta", "domain", "d")})
SELECT *, CASE WHEN valid_fraction >= 0.95 AND low > 0 THEN 'confirmed' WHEN median > 0 THEN 'directional' ELSE 'not_confirmed' END AS grade FROM i"""

QUERIES = {
    "hash_rank_folds": (hash_rank_folds, FOLDS_SQL),
    "cv_manifest": (cv_manifest, CV_SQL),
    "fold_validity": (fold_validity, VALIDITY_SQL),
    "logo_manifest": (logo_manifest, LOGO_SQL),
    "grouped_stratified_greedy": (grouped_stratified_greedy, None),
    "bootstrap_draws": (bootstrap_draws, f"WITH {PREDICTIONS}, {_DRAWN} SELECT * FROM drawn"),
    "cluster_expansion": (cluster_expansion, EXPANSION_SQL),
    "bootstrap_metrics": (bootstrap_metrics, METRICS_SQL),
    "bootstrap_ci": (bootstrap_ci, f"WITH {_RESAMPLED} {_interval_sql('ap_lift', 'domain, method', 'rs')}"),
    "macro_bootstrap_min2": (macro_bootstrap_min2, MACRO_SQL),
    "pooled_bootstrap": (pooled_bootstrap, POOLED_SQL),
    "paired_delta_ci": (paired_delta_ci, PAIRED_SQL),
}
