"""Metric, ranking and selection queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators import joins, metrics, ranking
from waymark.plans.base import PREDICTIONS, RATES, confusion_sql, predictions, ranking_sql, rounded, table

_RATE_NAMES = ("precision", "recall", "f1", "f2", "balanced_accuracy", "mcc", "specificity", "false_positive_rate", "predicted_positive_rate")
_KEYS = "target, method, domain"


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: rounded(F.col(n)) for n in names})


def _rounded_sql(*names: str) -> str:
    return ", ".join(f"round({n}, 9) + 0.0 AS {n}" for n in names)


def confusion_by_group(spark, sf):
    return metrics.confusion(predictions(spark, sf), "target", "method", "domain")


def metric_rates_by_group(spark, sf):
    found = metrics.rates(metrics.confusion(predictions(spark, sf), "target", "method", "domain"))
    return _round(found, *_RATE_NAMES)


RATES_SQL = f"""WITH {PREDICTIONS}, {confusion_sql(_KEYS)}, rated AS (
    SELECT *, {RATES} FROM (SELECT *, positives BETWEEN 1 AND n - 1 AS mixed FROM conf)
) SELECT {_KEYS}, n, positives, tp, fp, fn, tn, {_rounded_sql(*_RATE_NAMES)}, metric_status FROM rated"""


def average_precision_by_group(spark, sf):
    found = metrics.ranking(predictions(spark, sf), "target", "method", "domain")
    return _round(found.select("target", "method", "domain", "n", "positives", "average_precision", "ap_lift"), "average_precision", "ap_lift")


AP_SQL = f"""WITH {PREDICTIONS}, {ranking_sql(_KEYS)}
SELECT {_KEYS}, n, positives, {_rounded_sql("average_precision", "ap_lift")} FROM ranked"""


def roc_auc_by_group(spark, sf):
    found = metrics.ranking(predictions(spark, sf), "target", "method")
    return _round(found.select("target", "method", "roc_auc", "prevalence"), "roc_auc", "prevalence")


#: Another way to the same number: ranks with ties at their middle.
AUC_SQL = f"""WITH {PREDICTIONS}, r AS (
    SELECT *, rank() OVER (PARTITION BY target, method ORDER BY score) + (count(*) OVER (PARTITION BY target, method, score) - 1) / 2.0::DOUBLE AS mid FROM pred
), s AS (
    SELECT target, method, sum(mid) FILTER (label = 1) AS up, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS q FROM r GROUP BY target, method
) SELECT target, method, round((up - p * (p + 1) / 2.0::DOUBLE) / nullif(p * q, 0), 9) + 0.0 AS roc_auc, round(p / (p + q)::DOUBLE, 9) + 0.0 AS prevalence FROM s"""


def metric_bundle_pooled(spark, sf):
    found = metrics.bundle(predictions(spark, sf), "target", "method")
    names = (*_RATE_NAMES, "prevalence", "average_precision", "ap_lift", "roc_auc", "mean_probability", "median_probability", "max_probability")
    return _round(found, *names)


BUNDLE_SQL = f"""WITH {PREDICTIONS}, {confusion_sql("target, method")}, {ranking_sql("target, method")}, s AS (
    SELECT target, method, avg(score) AS mean_probability, median(score) AS median_probability, max(score) AS max_probability FROM pred GROUP BY target, method
), rated AS (SELECT *, {RATES} FROM (SELECT *, positives BETWEEN 1 AND n - 1 AS mixed FROM conf))
SELECT target, method, rated.n, rated.positives, tp, fp, fn, tn, {_rounded_sql(*_RATE_NAMES)}, metric_status,
    {_rounded_sql("prevalence", "average_precision", "ap_lift", "roc_auc", "mean_probability", "median_probability", "max_probability")}
FROM rated JOIN ranked USING (target, method) JOIN s USING (target, method)"""


def metric_tables(spark, sf):
    """By domain and pooled, as one table."""
    scored = predictions(spark, sf).where("method = 'B4'")
    both = scored.select("*", F.explode(F.array(F.col("domain"), F.lit("pooled"))).alias("scope"))
    found = metrics.ranking(both, "target", "scope")
    return _round(found, "prevalence", "average_precision", "ap_lift", "roc_auc")


TABLES_SQL = f"""WITH {PREDICTIONS}, both_scopes AS (
    SELECT *, domain AS scope FROM pred WHERE method = 'B4' UNION ALL SELECT *, 'pooled' FROM pred WHERE method = 'B4'
), {ranking_sql("target, scope", "both_scopes")}
SELECT target, scope, n, positives, {_rounded_sql("prevalence", "average_precision", "ap_lift", "roc_auc")} FROM ranked"""


def macro_valid_domains(spark, sf):
    cells = metrics.ranking(predictions(spark, sf), "target", "method", "group_key")
    return _round(metrics.macro(cells, "average_precision", "target", "method"), "macro_mean", "macro_std")


MACRO_SQL = f"""WITH {PREDICTIONS}, {ranking_sql("target, method, group_key")}
SELECT target, method, round(avg(average_precision), 9) + 0.0 AS macro_mean, round(stddev_samp(average_precision), 9) + 0.0 AS macro_std,
    count(average_precision) AS n_cells, count(*) FILTER (average_precision IS NULL) AS n_excluded
FROM ranked GROUP BY target, method"""


def macro_conditional_full_coverage(spark, sf):
    """Macro over groups that occur in every language, and over all."""
    scored = predictions(spark, sf).where("method = 'B4'")
    langs = scored.select("domain").distinct().agg(F.count("*").alias("_all"))
    wide = scored.groupBy("group_key").agg(F.count_distinct("domain").alias("_own")).crossJoin(langs)
    status = wide.select("group_key", F.when(F.col("_own") == F.col("_all"), "full").otherwise("partial").alias("coverage"))
    cells = metrics.ranking(scored, "target", "group_key").join(status, "group_key")
    full = metrics.macro(cells, "ap_lift", "target", condition=F.col("coverage") == "full")
    every = metrics.macro(cells, "ap_lift", "target").select("target", F.col("macro_mean").alias("macro_all"), F.col("n_cells").alias("n_all"))
    found = full.select("target", F.col("macro_mean").alias("macro_full"), F.col("n_cells").alias("n_full")).join(every, "target")
    return _round(found, "macro_full", "macro_all")


CONDITIONAL_SQL = f"""WITH {PREDICTIONS}, own AS (SELECT * FROM pred WHERE method = 'B4'), {ranking_sql("target, group_key", "own")}, status AS (
    SELECT group_key, count(DISTINCT domain) = (SELECT count(DISTINCT domain) FROM own) AS is_full FROM own GROUP BY group_key
) SELECT target, round(avg(ap_lift) FILTER (is_full), 9) + 0.0 AS macro_full, count(ap_lift) FILTER (is_full) AS n_full,
    round(avg(ap_lift), 9) + 0.0 AS macro_all, count(ap_lift) AS n_all
FROM ranked JOIN status USING (group_key) GROUP BY target"""


def ap_lift_vs_best_dummy(spark, sf):
    cells = metrics.ranking(predictions(spark, sf), "target", "domain", "method")
    found = metrics.delta_to_best(cells, "average_precision", "method", ("B0", "B1"), "target", "domain")
    return _round(found.select("target", "domain", "method", "average_precision", "best_reference", "delta"), "average_precision", "best_reference", "delta")


DUMMY_SQL = f"""WITH {PREDICTIONS}, {ranking_sql("target, domain, method")}, b AS (
    SELECT *, max(average_precision) FILTER (method IN ('B0', 'B1')) OVER (PARTITION BY target, domain) AS best_reference FROM ranked
) SELECT target, domain, method, {_rounded_sql("average_precision", "best_reference")}, round(average_precision - best_reference, 9) + 0.0 AS delta FROM b"""


def variant_delta_self_join(spark, sf):
    cells = metrics.ranking(predictions(spark, sf), "target", "domain", "method")
    found = metrics.delta_to_variant(cells, "roc_auc", "method", "B2", "target", "domain").where("method <> 'B2'")
    return _round(found.select("target", "domain", "method", "base_value", "delta"), "base_value", "delta")


VARIANT_SQL = f"""WITH {PREDICTIONS}, {ranking_sql("target, domain, method")}
SELECT v.target, v.domain, v.method, round(s.roc_auc, 9) + 0.0 AS base_value, round(v.roc_auc - s.roc_auc, 9) + 0.0 AS delta
FROM ranked v JOIN ranked s ON v.target = s.target AND v.domain = s.domain AND s.method = 'B2' WHERE v.method <> 'B2'"""


def retained_lift_class(spark, sf):
    found = metrics.variant_dependency(predictions(spark, sf), "method", "B4", "domain", "target", sufficiency=("B0",))
    return _round(found, "retained_ratio")


RETAINED_SQL = f"""WITH {PREDICTIONS}, {ranking_sql("target, method", name="p")}, {ranking_sql("target, domain, method", name="d")}, r AS (
    SELECT v.target, v.method, CASE WHEN s.ap_lift > 0 THEN CASE WHEN v.ap_lift <= 0 THEN 0 ELSE v.ap_lift / s.ap_lift END END AS ratio
    FROM p v JOIN p s ON v.target = s.target AND s.method = 'B4'
), c AS (
    SELECT v.target, v.method, count(v.average_precision - s.average_precision) AS domains, count(*) FILTER (v.average_precision < s.average_precision) AS declines,
        count(*) FILTER (v.average_precision - s.average_precision <= -0.05) AS large_declines
    FROM d v JOIN d s ON v.target = s.target AND v.domain = s.domain AND s.method = 'B4' GROUP BY v.target, v.method
) SELECT target, method, round(ratio, 9) + 0.0 AS retained_ratio, domains, declines, large_declines, CASE WHEN method = 'B4' THEN 'reference'
    WHEN method = 'B0' THEN 'sufficiency_only_not_dependency_grade' WHEN ratio IS NULL THEN 'not_assessable_nonpositive_s0_ap_lift'
    WHEN ratio < 0.5 AND declines >= ceil(domains * 0.75) AND large_declines >= 2 THEN 'strong_dependency'
    WHEN ratio >= 0.5 AND ratio < 0.8 AND declines > domains / 2 THEN 'moderate_dependency' ELSE 'limited_dependency' END AS dependency
FROM r JOIN c USING (target, method)"""


def signal_grades(spark, sf):
    """A grade per target; the languages stand for the folds."""
    scored = predictions(spark, sf)

    def cells(*keys):
        found = metrics.rates(metrics.confusion(scored, *keys)).select(*keys, "f1")
        return metrics.ranking(scored, *keys).join(found, list(keys))

    return metrics.signal_grades(cells("target", "method"), cells("target", "domain", "method"), "method", "domain", ("B0", "B1"), ("B2", "B3", "B4"), "target")


GRADES_SQL = f"""WITH {PREDICTIONS}, {ranking_sql("target, method", name="p")}, {confusion_sql("target, method", name="pc")},
{ranking_sql("target, domain, method", name="d")}, {confusion_sql("target, domain, method", name="dc")}, pooled AS (
    SELECT target, method, average_precision > prevalence AS ap, CASE WHEN pc.positives BETWEEN 1 AND pc.n - 1 THEN 2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE END AS f1
    FROM p JOIN pc USING (target, method)
), folds AS (
    SELECT target, domain, method, average_precision > prevalence AS ap, CASE WHEN dc.positives BETWEEN 1 AND dc.n - 1 THEN coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) END AS f1
    FROM d JOIN dc USING (target, domain, method)
), improved AS (
    SELECT f.target, f.method, count(*) FILTER (f.ap AND f.f1 > b.best) AS improved FROM folds f
    JOIN (SELECT target, domain, max(f1) AS best FROM folds WHERE method IN ('B0', 'B1') GROUP BY target, domain) b USING (target, domain) GROUP BY f.target, f.method
), j AS (
    SELECT target, coalesce(ap, false) AS ap, coalesce(coalesce(f1, 0) > best, false) AS f1, improved FROM pooled JOIN improved USING (target, method)
    JOIN (SELECT target, max(coalesce(f1, 0)) AS best FROM pooled WHERE method IN ('B0', 'B1') GROUP BY target) USING (target) WHERE method IN ('B2', 'B3', 'B4')
) SELECT target, CASE WHEN bool_or(ap AND f1 AND improved >= 2) THEN 'clear_provisional_signal' WHEN NOT bool_or(ap OR f1) THEN 'no_obvious_signal'
    ELSE 'weak_or_mixed_signal' END AS grade FROM j GROUP BY target"""


def method_pivot(spark, sf):
    found = metrics.ranking(predictions(spark, sf).where("method IN ('B2', 'B3', 'B4')"), "target", "method")
    wide = found.groupBy("target").pivot("method", ["B2", "B3", "B4"]).agg(F.first("average_precision"))
    wide = wide.withColumns({"b4_minus_b2": F.col("B4") - F.col("B2"), "b4_minus_b3": F.col("B4") - F.col("B3")}).withColumnsRenamed({m: m.lower() for m in ("B2", "B3", "B4")})
    return _round(wide, "b2", "b3", "b4", "b4_minus_b2", "b4_minus_b3")


PIVOT_SQL = f"""WITH {PREDICTIONS}, {ranking_sql("target, method")}, w AS (
    SELECT target, max(average_precision) FILTER (method = 'B2') AS b2, max(average_precision) FILTER (method = 'B3') AS b3,
        max(average_precision) FILTER (method = 'B4') AS b4 FROM ranked GROUP BY target
) SELECT target, {_rounded_sql("b2", "b3", "b4")}, round(b4 - b2, 9) + 0.0 AS b4_minus_b2, round(b4 - b3, 9) + 0.0 AS b4_minus_b3 FROM w"""


def threshold_grid_select(spark, sf):
    return _round(ranking.threshold_by_f1(predictions(spark, sf), "target", "method"), "f1", "recall")


THRESHOLD_SQL = f"""WITH {PREDICTIONS}, g AS (SELECT i / 20.0::DOUBLE AS threshold FROM range(1, 20) t(i)), c AS (
    SELECT target, method, threshold, count(*) FILTER (label = 1 AND score >= threshold) AS tp, count(*) FILTER (label = 0 AND score >= threshold) AS fp,
        count(*) FILTER (label = 1 AND score < threshold) AS fn FROM pred, g GROUP BY target, method, threshold
), m AS (SELECT *, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall FROM c)
SELECT target, method, threshold, round(f1, 9) + 0.0 AS f1, round(recall, 9) + 0.0 AS recall FROM m
QUALIFY row_number() OVER (PARTITION BY target, method ORDER BY f1 DESC, recall DESC, abs(threshold - 0.5), threshold) = 1"""


def config_argmax_tiebreak(spark, sf):
    """The best configuration of a cell within a tolerance; ties by registry order, not by name."""
    cells = metrics.ranking(predictions(spark, sf), "target", "domain", "method")
    order = F.array_position(F.array(*[F.lit(m) for m in ("B3", "B1", "B4", "B0", "B2")]), F.col("method"))
    found = ranking.best_within(cells, ["target", "domain"], "prevalence", 1e-15, order, F.col("method"))
    return _round(found.select("target", "domain", "method", "prevalence"), "prevalence")


ARGMAX_SQL = f"""WITH {PREDICTIONS}, {ranking_sql("target, domain, method")}
SELECT target, domain, method, round(prevalence, 9) + 0.0 AS prevalence FROM ranked
QUALIFY row_number() OVER (PARTITION BY target, domain ORDER BY prevalence DESC, list_position(['B3', 'B1', 'B4', 'B0', 'B2'], method)) = 1"""


def config_selection_frequency(spark, sf):
    cells = metrics.ranking(predictions(spark, sf), "target", "domain", "method").where("average_precision IS NOT NULL")
    chosen = ranking.first_by(cells, ["target", "domain"], F.desc(F.round("average_precision", 9)), F.col("method"))
    return ranking.selection_frequency(cells.select("target", "method").distinct(), chosen, "target", "method")


FREQUENCY_SQL = f"""WITH {PREDICTIONS}, {ranking_sql("target, domain, method")}, ok AS (SELECT * FROM ranked WHERE average_precision IS NOT NULL), c AS (
    SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY target, domain ORDER BY round(average_precision, 9) DESC, method) = 1
) SELECT g.target, g.method, count(c.method) AS times_selected
FROM (SELECT DISTINCT target, method FROM ok) g LEFT JOIN c ON g.target = c.target AND g.method = c.method GROUP BY g.target, g.method"""


def best_worst_domain(spark, sf):
    cells = metrics.ranking(predictions(spark, sf), "target", "method", "domain").withColumn("m", F.round("average_precision", 9))
    return ranking.best_and_worst(cells, ["target", "method"], "m", "domain")


BEST_SQL = f"""WITH {PREDICTIONS}, {ranking_sql("target, method, domain")}, c AS (SELECT target, method, domain, round(average_precision, 9) + 0.0 AS m FROM ranked WHERE average_precision IS NOT NULL)
SELECT target, method, first(domain ORDER BY m DESC, domain) AS best, max(m) AS best_value, first(domain ORDER BY m, domain) AS worst, min(m) AS worst_value
FROM c GROUP BY target, method"""


def error_case_selection(spark, sf):
    wrong = predictions(spark, sf).where("label <> predicted").withColumn("threshold", F.lit(0.5))
    found = ranking.error_cases(wrong, ["target", "method", "label"], "unit", "score", "threshold")
    return found.select("target", "method", "label", "selection", "unit", "score")


ERRORS_SQL = f"""WITH {PREDICTIONS}, e AS (
    SELECT target, method, label, list({{'unit': unit, 'score': score}} ORDER BY abs(score - 0.5), unit) AS near,
        list({{'unit': unit, 'score': score}} ORDER BY abs(score - 0.5) DESC, unit) AS far
    FROM pred WHERE label <> predicted GROUP BY target, method, label
), s AS (
    SELECT target, method, label, unnest(['nearest', 'median', 'farthest']) AS selection, unnest([near[1], near[(len(near) - 1) // 2 + 1], far[1]]) AS c FROM e
) SELECT target, method, label, selection, c.unit AS unit, c.score AS score FROM s"""


def coefficient_rank(spark, sf):
    """Signed coefficients (here: mean prices by brand and size class) ranked by magnitude, then name."""
    parts = table(spark, sf, "part").groupBy("p_type", "p_brand").agg(F.round(F.avg("p_retailprice") - 1000, 4).alias("coefficient"))
    order = [F.desc(F.abs(F.col("coefficient"))), F.col("p_brand")]
    return ranking.top_joined(parts, ["p_type"], "p_brand", order, 5)


COEFFICIENT_SQL = """WITH c AS (SELECT p_type, p_brand, round(avg(p_retailprice) - 1000, 4) AS coefficient FROM part GROUP BY ALL), r AS (
    SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY abs(coefficient) DESC, p_brand) AS k FROM c
) SELECT p_type, string_agg(p_brand, ';' ORDER BY k) AS top FROM r WHERE k <= 5 GROUP BY p_type"""


def probe_min_per_combo(spark, sf):
    docs = table(spark, sf, "documents").select("source", "lang", "doc_id", "n_chars")
    return ranking.first_by(docs, ["source", "lang"], F.col("n_chars"), F.col("doc_id"))


PROBE_SQL = """SELECT source, lang, doc_id, n_chars FROM documents
QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY n_chars, doc_id) = 1"""


def row_equality(spark, sf):
    """Two prediction tables compared row by row."""
    scored = predictions(spark, sf)
    a = scored.where("method = 'B2'").select("unit", "target", "score", "predicted")
    b = scored.where("method = 'B3'").select("unit", "target", "score", "predicted")
    found = joins.compared(a, b, ["unit", "target"], ["score", "predicted"])
    return _round(found, "max_difference")


EQUALITY_SQL = f"""WITH {PREDICTIONS}, j AS (
    SELECT a.unit AS ua, b.unit AS ub, a.score AS sa, b.score AS sb, a.predicted AS pa, b.predicted AS pb
    FROM (SELECT * FROM pred WHERE method = 'B2') a FULL JOIN (SELECT * FROM pred WHERE method = 'B3') b ON a.unit = b.unit AND a.target = b.target
) SELECT count(*) FILTER (ua IS NOT NULL AND ub IS NOT NULL) AS compared, count(*) FILTER (ua IS NULL OR ub IS NULL) AS unpaired,
    count(*) FILTER (sa <> sb OR pa <> pb) AS unequal, round(max(greatest(abs(sa - sb), abs(pa - pb))), 9) AS max_difference FROM j"""

QUERIES = {
    "confusion_by_group": (confusion_by_group, f"WITH {PREDICTIONS}, {confusion_sql(_KEYS)} SELECT * FROM conf"),
    "metric_rates_by_group": (metric_rates_by_group, RATES_SQL),
    "average_precision_by_group": (average_precision_by_group, AP_SQL),
    "roc_auc_by_group": (roc_auc_by_group, AUC_SQL),
    "metric_bundle_pooled": (metric_bundle_pooled, BUNDLE_SQL),
    "metric_tables": (metric_tables, TABLES_SQL),
    "macro_valid_domains": (macro_valid_domains, MACRO_SQL),
    "macro_conditional_full_coverage": (macro_conditional_full_coverage, CONDITIONAL_SQL),
    "ap_lift_vs_best_dummy": (ap_lift_vs_best_dummy, DUMMY_SQL),
    "variant_delta_self_join": (variant_delta_self_join, VARIANT_SQL),
    "retained_lift_class": (retained_lift_class, RETAINED_SQL),
    "signal_grades": (signal_grades, GRADES_SQL),
    "method_pivot": (method_pivot, PIVOT_SQL),
    "threshold_grid_select": (threshold_grid_select, THRESHOLD_SQL),
    "config_argmax_tiebreak": (config_argmax_tiebreak, ARGMAX_SQL),
    "config_selection_frequency": (config_selection_frequency, FREQUENCY_SQL),
    "best_worst_domain": (best_worst_domain, BEST_SQL),
    "error_case_selection": (error_case_selection, ERRORS_SQL),
    "coefficient_rank": (coefficient_rank, COEFFICIENT_SQL),
    "probe_min_per_combo": (probe_min_per_combo, PROBE_SQL),
    "row_equality": (row_equality, EQUALITY_SQL),
}
