"""Queries on cleaned records, contracts and variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators import metrics, records as cleaned_records
from waymark.plans.base import PREDICTIONS, RECORDS, predictions, ranking_sql, records, rounded, table


def cleaned_record_flags(spark, sf):
    """Terminal fields and quality flags of cleaned records, counted."""
    found = cleaned_records.cleaned(records(spark, sf))
    return found.select("key", "terminal.last_step_index", "quality_flags.*", F.size("steps").alias("n_steps"))


FLAGS_SQL = f"""WITH {RECORDS}, t AS (SELECT conv_id AS key, first(text ORDER BY turn) AS task FROM conversations GROUP BY conv_id), g AS (
    SELECT key, CAST(count(*) AS INT) AS n_steps, count(act) > 0 AS has_action, count(obs) > 0 AS has_observation,
        count(nullif(regexp_replace(reasoning, '^\\s+|\\s+$', '', 'g'), '')) > 0 AS has_reasoning, count(error) > 0 AS has_natural_error FROM clean GROUP BY key
) SELECT key, n_steps AS last_step_index, regexp_replace(task, '^\\s+|\\s+$', '', 'g') <> '' AS has_task_instruction, n_steps > 0 AS has_steps, has_action, has_observation,
    has_reasoning, has_natural_error, n_steps FROM g JOIN t USING (key)""".replace("\\\\", "\\")


def prediction_contract(spark, sf):
    """Prediction rows that break the contract, by rule; some rows are spoiled on purpose."""
    unit = F.col("unit")
    rows = predictions(spark, sf).where("method = 'B4' AND target = 'toxic'").select(
        F.concat_ws("::", F.when(unit % 11 == 0, F.lit("other::x")).otherwise(F.concat("domain", F.lit("::"), "group_key")), unit.cast("string")).alias("trajectory_key"),
        F.concat_ws("::", "domain", "group_key").alias("group_key"),
        F.when(unit % 13 == 0, F.lit("xx")).otherwise(F.col("domain")).alias("held_out_group"),
        F.when(unit % 17 == 0, F.lit(2)).otherwise(F.col("label")).alias("true_label"),
        F.when(unit % 19 == 0, F.lit(1.5)).otherwise(F.col("score")).alias("predicted_probability"),
        F.lit(0.5).alias("selected_threshold"),
        F.when(unit % 23 == 0, 1 - F.col("predicted")).otherwise(F.when(unit % 19 == 0, 1).otherwise(F.col("predicted"))).alias("predicted_label"),
    )
    found = cleaned_records.violations(rows, "trajectory_key", cleaned_records.prediction_rules())
    return found.groupBy("violation").agg(F.count("*").alias("n"))


CONTRACT_SQL = f"""WITH {PREDICTIONS}, p AS (SELECT * FROM pred WHERE method = 'B4' AND target = 'toxic'), v AS (
    SELECT unit, 'key_outside_group' AS violation FROM p WHERE unit % 11 = 0 UNION ALL SELECT unit, 'group_outside_fold' FROM p WHERE unit % 13 = 0
    UNION ALL SELECT unit, 'label_not_binary' FROM p WHERE unit % 17 = 0 UNION ALL SELECT unit, 'probability_range' FROM p WHERE unit % 19 = 0
    UNION ALL SELECT unit, 'label_not_by_threshold' FROM p WHERE unit % 23 = 0 AND NOT (unit % 19 = 0 AND predicted = 0)
) SELECT violation, count(*) AS n FROM v GROUP BY violation"""


def consistent_variants(spark, sf):
    rows = table(spark, sf, "part").select("p_brand", "p_type", F.when(F.col("p_brand") == "Brand#3", F.col("p_size")).otherwise(F.lit(1)).alias("f"), F.lit(2).alias("g"))
    return cleaned_records.consistent_variants(rows, ["p_brand"], "f", "g")


CONSISTENT_SQL = """SELECT p_brand, 1 AS f, 2 AS g FROM (SELECT p_brand, count(DISTINCT CASE WHEN p_brand = 'Brand#3' THEN p_size ELSE 1 END) AS n FROM part GROUP BY p_brand) WHERE n <= 1"""


def target_support(spark, sf):
    return cleaned_records.support(predictions(spark, sf).where("method = 'B2'"), "target", "domain")


SUPPORT_SQL = f"""WITH {PREDICTIONS} SELECT target, domain, count(*) AS rows, CAST(sum(label) AS BIGINT) AS positives, count(DISTINCT group_key) AS groups,
    count(DISTINCT CASE WHEN label = 1 THEN group_key END) AS positive_groups FROM pred WHERE method = 'B2' GROUP BY target, domain"""


def status_wording(spark, sf):
    """Grades mapped to the section, priority and wording they allow."""
    cells = metrics.ranking(predictions(spark, sf), "target", "method", "domain")
    grade = metrics.evidence_grade(F.col("ap_lift") - 0.05, F.col("ap_lift"))
    found = cells.select("target", "method", "domain", cleaned_records.status_text(grade).alias("t"), grade.alias("grade"))
    return found.select("target", "method", "domain", "grade", "t.*").where("method IN ('B2', 'B4')")


WORDING_SQL = f"""WITH {PREDICTIONS}, {ranking_sql("target, method, domain")}, g AS (
    SELECT target, method, domain, CASE WHEN ap_lift - 0.05 > 0 THEN 'confirmed' WHEN ap_lift > 0 THEN 'directional' ELSE 'not_confirmed' END AS grade FROM ranked WHERE method IN ('B2', 'B4')
) SELECT *, CASE grade WHEN 'not_confirmed' THEN 'limitations' ELSE 'results' END AS section, CASE grade WHEN 'confirmed' THEN 1 WHEN 'directional' THEN 2 ELSE 3 END AS priority,
    CASE grade WHEN 'confirmed' THEN 'proves' WHEN 'directional' THEN 'confirms' ELSE 'shows' END AS forbidden FROM g"""


def namespace_task_overlap(spark, sf):
    """Keys that two namespaces share, for every pair of languages."""
    docs = table(spark, sf, "documents").select("lang", "source").distinct()
    a, b = docs.alias("a"), docs.alias("b")
    pairs = a.join(b, F.col("a.source") == F.col("b.source")).where("a.lang < b.lang")
    return pairs.groupBy(F.col("a.lang").alias("first"), F.col("b.lang").alias("second")).agg(F.count("*").alias("shared"))


OVERLAP_SQL = """WITH d AS (SELECT DISTINCT lang, source FROM documents)
SELECT a.lang AS first, b.lang AS second, count(*) AS shared FROM d a JOIN d b ON a.source = b.source AND a.lang < b.lang GROUP BY a.lang, b.lang"""


def linear_model_scores(spark, sf):
    """A fixed linear model applied to features; its probabilities and inclusive labels."""
    model = cleaned_records.LinearModel(("p_size", "p_retailprice"), (25.0, 1400.0), (14.0, 300.0), (0.75, -0.5), 0.1)
    scored = table(spark, sf, "part").select("p_partkey", model.probability().alias("p"))
    return scored.select("p_partkey", rounded(F.col("p")).alias("probability"), (F.col("p") >= 0.5).cast("int").alias("predicted"))


SCORES_SQL = """WITH s AS (SELECT p_partkey, 1 / (1 + exp(-(0.1::DOUBLE + (p_size - 25.0::DOUBLE) / 14.0::DOUBLE * 0.75::DOUBLE + (p_retailprice - 1400.0::DOUBLE) / 300.0::DOUBLE * -0.5::DOUBLE))) AS p FROM part)
SELECT p_partkey, round(p, 9) AS probability, CAST(p >= 0.5 AS INT) AS predicted FROM s"""

QUERIES = {
    "cleaned_record_flags": (cleaned_record_flags, FLAGS_SQL),
    "prediction_contract": (prediction_contract, CONTRACT_SQL),
    "consistent_variants": (consistent_variants, CONSISTENT_SQL),
    "target_support": (target_support, SUPPORT_SQL),
    "status_wording": (status_wording, WORDING_SQL),
    "namespace_task_overlap": (namespace_task_overlap, OVERLAP_SQL),
    "linear_model_scores": (linear_model_scores, SCORES_SQL),
}
