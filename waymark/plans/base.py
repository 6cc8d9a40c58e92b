"""Stand-ins for the engine's records, built from the provided tables, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

METHODS = ("B0", "B1", "B2", "B3", "B4")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(x: Column, digits: int = 9) -> Column:
    """Rounded, and never a negative zero."""
    return F.round(x.cast("double"), digits) + F.lit(0.0)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, instruction, steps): a record per conversation; its first turn is the task, assistant turns are actions."""
    turns = table(spark, sf_dir, "conversations")

    def of(role: str) -> Column:
        return F.when(F.col("role") == role, F.col("text"))

    other = ~F.coalesce(F.col("role").isin("assistant", "user", "system"), F.lit(False))
    step = F.struct(
        (F.col("turn") + 1).cast("int").alias("step_index"),
        of("assistant").alias("action"),
        of("user").alias("observation"),
        F.when(F.col("text").contains("#"), F.lit("mark")).alias("error"),
        of("system").alias("reasoning"),
        F.substring(of("user"), 1, 3).alias("focused_element"),
        F.when(other, F.col("role")).alias("tool_name"),
        F.lit(None).cast("string").alias("tool_input"),
        F.when(other, F.col("text")).alias("tool_output"),
    )
    steps = F.array_sort(F.collect_list(step)).alias("steps")
    return turns.groupBy(F.col("conv_id").alias("key")).agg(steps, F.min_by("text", "turn").alias("instruction"))


RECORDS = """steps AS (
    SELECT conv_id AS key, CAST(turn + 1 AS INT) AS step_index, text, turn,
        CASE WHEN role = 'assistant' THEN text END AS action, CASE WHEN role = 'user' THEN text END AS observation,
        CASE WHEN contains(text, '#') THEN 'mark' END AS error, CASE WHEN role = 'system' THEN text END AS reasoning,
        CASE WHEN role = 'user' THEN substr(text, 1, 3) END AS focused,
        CASE WHEN role IN ('assistant', 'user', 'system') THEN NULL ELSE role END AS tool_name,
        CASE WHEN role IN ('assistant', 'user', 'system') THEN NULL ELSE text END AS tool_output
    FROM conversations
), clean AS (
    SELECT *, nullif(regexp_replace(regexp_replace(action, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'), '') AS act,
        nullif(regexp_replace(observation, '^\\s+|\\s+$', '', 'g'), '') AS obs, nullif(regexp_replace(focused, '^\\s+|\\s+$', '', 'g'), '') AS foc
    FROM steps
)""".replace("\\\\", "\\")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit, domain, group_key, target, label, method, score, predicted): scored documents with two targets and five methods."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    joined = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    targets = F.inline(F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).cast("int").alias("label")) for t in ("quality", "toxic")]))
    group = F.concat_ws("::", "source", (F.col("doc_id") % 5).cast("string"))
    long = joined.select(F.col("doc_id").alias("unit"), F.col("lang").alias("domain"), group.alias("group_key"), targets)
    unit = F.col("unit")
    scores = {
        "B0": F.lit(1.0),
        "B1": F.lit(0.5),
        "B2": (unit * 7919 % 100) / 100,
        "B3": (unit * 104729 % 50) / 50,
        "B4": ((unit * 131 % 100) + 50 * F.col("label")) / 200,
    }
    methods = F.inline(F.array(*[F.struct(F.lit(m).alias("method"), s.cast("double").alias("score")) for m, s in scores.items()]))
    return long.select("*", methods).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


PREDICTIONS = """scored AS (
    SELECT unit, domain, group_key, target, label, unnest(['B0', 'B1', 'B2', 'B3', 'B4']) AS method FROM (
        SELECT d.doc_id AS unit, d.lang AS domain, d.source || '::' || (d.doc_id % 5) AS group_key,
            unnest(['quality', 'toxic']) AS target, unnest([l.quality, l.toxic]) AS label
        FROM documents d JOIN labels l USING (doc_id))
), valued AS (
    SELECT *, CASE method WHEN 'B0' THEN 1.0::DOUBLE WHEN 'B1' THEN 0.5::DOUBLE WHEN 'B2' THEN (unit * 7919 % 100) / 100.0::DOUBLE
        WHEN 'B3' THEN (unit * 104729 % 50) / 50.0::DOUBLE ELSE ((unit * 131 % 100) + 50 * label) / 200.0::DOUBLE END AS score
    FROM scored
), pred AS (SELECT *, CAST(score >= 0.5 AS INT) AS predicted FROM valued)"""


def ranking_sql(keys: str, source: str = "pred", name: str = "ranked", weight: str = "1") -> str:
    """CTEs that end in ``name``: (keys, n, positives, prevalence, average_precision, ap_lift, roc_auc)."""
    return f"""{name}_steps AS (
    SELECT {keys}, score, sum(label * {weight}) AS tp, sum({weight}) AS n FROM {source} GROUP BY {keys}, score
), {name}_run AS (
    SELECT *, sum(tp) OVER w AS tps, sum(n) OVER w AS ns FROM {name}_steps
    WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), {name}_sums AS (
    SELECT {keys}, CAST(sum(n) AS BIGINT) AS n, CAST(sum(tp) AS BIGINT) AS positives,
        sum(tp::DOUBLE * tps / ns) / sum(tp) AS ap, sum((n - tp) * (tps - tp / 2.0::DOUBLE)) AS above
    FROM {name}_run GROUP BY {keys}
), {name} AS (
    SELECT {keys}, n, positives, positives / n::DOUBLE AS prevalence,
        CASE WHEN positives BETWEEN 1 AND n - 1 THEN ap END AS average_precision,
        CASE WHEN positives BETWEEN 1 AND n - 1 THEN ap - positives / n::DOUBLE END AS ap_lift,
        CASE WHEN positives BETWEEN 1 AND n - 1 THEN above / (positives * (n - positives)) END AS roc_auc
    FROM {name}_sums
)"""


def confusion_sql(keys: str, source: str = "pred", name: str = "conf") -> str:
    return f"""{name} AS (
    SELECT {keys}, count(*) AS n, count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 1 AND predicted = 1) AS tp,
        count(*) FILTER (label = 0 AND predicted = 1) AS fp, count(*) FILTER (label = 1 AND predicted = 0) AS fn,
        count(*) FILTER (label = 0 AND predicted = 0) AS tn
    FROM {source} GROUP BY {keys}
)"""


#: Columns of rates() over confusion counts, in SQL.
RATES = """CASE WHEN mixed THEN coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) END AS precision,
        CASE WHEN mixed THEN coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) END AS recall,
        CASE WHEN mixed THEN coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) END AS f1,
        CASE WHEN mixed THEN coalesce(5 * tp / nullif(5 * tp + 4 * fn + fp, 0)::DOUBLE, 0) END AS f2,
        CASE WHEN mixed THEN (coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) + tn / nullif(tn + fp, 0)::DOUBLE) / 2 END AS balanced_accuracy,
        CASE WHEN mixed THEN coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) END AS mcc,
        tn / nullif(tn + fp, 0)::DOUBLE AS specificity, fp / nullif(fp + tn, 0)::DOUBLE AS false_positive_rate,
        (tp + fp) / nullif(n, 0)::DOUBLE AS predicted_positive_rate, CASE WHEN mixed THEN 'ok' ELSE 'single_class' END AS metric_status"""
