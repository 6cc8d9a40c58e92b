"""Queries over step records and annotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import scalar, steps
from waymark.operators import joins, labels
from waymark.plans.base import RECORDS, records, rounded, table

_DOUBLES = ("natural_error_step_ratio", "action_char_count_mean_nonempty", "observation_char_count_mean_nonempty", "unique_action_ratio")


def steps_nested_features(spark, sf):
    """The structural features of every record."""
    signal = F.when(F.size("steps") % 2 == 0, F.lit("send_msg_to_user"))
    found = steps.structural_features(F.col("steps"), signal)
    return records(spark, sf).select("key", *[rounded(c).alias(n) if n in _DOUBLES else c.alias(n) for n, c in found.items()])


FEATURES_SQL = f"""WITH {RECORDS}, acts AS (
    SELECT key, act, lag(act) OVER (PARTITION BY key ORDER BY turn) AS before FROM clean WHERE act IS NOT NULL
), u AS (SELECT key, count(DISTINCT act) AS distinct_acts, count(*) FILTER (act = before) AS same FROM acts GROUP BY key), g AS (
    SELECT key, count(*) AS step_count, count(act) AS a, count(obs) AS o, count(foc) AS f, count(error) AS e,
        CAST(coalesce(sum(length(action)) FILTER (act IS NOT NULL), 0) AS BIGINT) AS ac,
        CAST(coalesce(sum(length(observation)) FILTER (obs IS NOT NULL), 0) AS BIGINT) AS oc FROM clean GROUP BY key
) SELECT key, step_count, a AS nonempty_action_count, o AS nonempty_observation_count, f AS nonempty_focused_element_count,
    e AS natural_error_step_count, round(e / step_count::DOUBLE, 9) AS natural_error_step_ratio, CASE WHEN step_count % 2 = 0 THEN 1 ELSE 0 END AS has_explicit_termination_signal,
    ac AS action_char_count_total, oc AS observation_char_count_total, round(coalesce(ac / nullif(a, 0)::DOUBLE, 0), 9) AS action_char_count_mean_nonempty,
    round(coalesce(oc / nullif(o, 0)::DOUBLE, 0), 9) AS observation_char_count_mean_nonempty,
    round(coalesce(distinct_acts / nullif(a, 0)::DOUBLE, 0), 9) AS unique_action_ratio, coalesce(same, 0) AS consecutive_duplicate_action_count
FROM g LEFT JOIN u USING (key)"""


def step_lag_duplicates(spark, sf):
    """Consecutive equal actions of a user, by lag."""
    from pyspark.sql import Window

    events = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id")
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    marked = events.withColumn("same", F.coalesce((F.col("event_type") == before).cast("int"), F.lit(0)))
    return marked.groupBy("user_id").agg(F.count("*").alias("steps"), F.sum("same").alias("duplicates"), F.count_if(F.col("event_type") == "error").alias("errors"))


LAG_SQL = """WITH m AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, count(*) AS steps, count(*) FILTER (event_type = before) AS duplicates, count(*) FILTER (event_type = 'error') AS errors FROM m GROUP BY user_id"""


def last_nonempty_step(spark, sf):
    s = F.col("steps")
    return records(spark, sf).select(
        "key",
        steps.last_nonempty(s, "action").alias("last_action"),
        steps.last_nonempty(s, "observation").alias("last_observation"),
        steps.last_step_index(s).alias("last_step_index"),
        scalar.termination_signal(steps.last_nonempty(s, "action"), ("stop", "send_msg_to_user")).alias("signal"),
    )


LAST_SQL = f"""WITH {RECORDS} SELECT key, last(action ORDER BY turn) FILTER (act IS NOT NULL) AS last_action,
    last(observation ORDER BY turn) FILTER (obs IS NOT NULL) AS last_observation, max(step_index) AS last_step_index, CAST(NULL AS VARCHAR) AS signal
FROM clean GROUP BY key"""


def termination_signals(spark, sf):
    events = table(spark, sf, "events")
    call = F.concat(F.lit(" "), F.col("event_type"), F.lit(" ("), F.col("user_id").cast("string"), F.lit(")"))
    signal = scalar.termination_signal(call, ("signup", "purchase"))
    return events.select(signal.alias("signal")).groupBy("signal").agg(F.count("*").alias("n"))


SIGNALS_SQL = """SELECT CASE WHEN event_type IN ('signup', 'purchase') THEN event_type END AS signal, count(*) AS n FROM events GROUP BY ALL"""


def text_view_serialise(spark, sf):
    """The three text views of each record."""
    views = F.inline(F.array(*[F.struct(F.lit(v).alias("view"), steps.text_view(F.col("instruction"), F.col("steps"), v).alias("text")) for v in steps.VIEWS]))
    return records(spark, sf).select("key", views).withColumn("content_sha256", F.sha2("text", 256)).drop("text")


def views_sql(select: str, views: str = "['primary_with_natural_errors', 'ablation_without_error_fields', 'sensitivity_with_reasoning']") -> str:
    """SQL over (key, view, task, body): the text of a view is the task's lines and the body."""

    def shown(tag: str, column: str, condition: str = "true") -> str:
        return f"CASE WHEN {column} <> '' AND {condition} THEN '{tag}:' || chr(10) || {column} END"

    fields = ", ".join(
        [shown("ACTION", "action"), shown("OBSERVATION", "observation"), shown("TOOL_NAME", "tool_name"), shown("TOOL_OUTPUT", "tool_output")]
        + [shown("FOCUSED_ELEMENT", "focused"), shown("ERROR", "error", "view <> 'ablation_without_error_fields'")]
        + [shown("REASONING", "reasoning", "view = 'sensitivity_with_reasoning'")]
    )
    return f"""WITH {RECORDS}, t AS (SELECT conv_id AS key, nullif(first(text ORDER BY turn), '') AS task FROM conversations GROUP BY conv_id), v AS (
    SELECT *, unnest({views}) AS view FROM clean
), p AS (
    SELECT key, view, step_index, list_filter([{fields}], lambda x: x IS NOT NULL) AS parts FROM v
), s AS (
    SELECT key, view, string_agg('[STEP ' || step_index || ']' || chr(10) || array_to_string(parts, chr(10)), chr(10) ORDER BY step_index)
        FILTER (len(parts) > 0) AS body FROM p GROUP BY key, view
), whole AS (
    SELECT key, view, task, body FROM s JOIN t USING (key)
) {select}"""


VIEWS_SQL = views_sql(
    "SELECT key, view, sha256(array_to_string(list_filter(['[TASK]' || chr(10) || task, body], lambda x: x IS NOT NULL), chr(10)) || chr(10)) AS content_sha256 FROM whole"
)


def _entries(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_suppkey")
    found = labels.collapsed(rows, "l_orderkey", value="l_returnflag", order="l_linenumber", unsure="N")
    return labels.resolved(found, "A", "R")


def consensus_labels(spark, sf):
    """One row per order from its repeated annotations (the flags of its lines)."""
    return _entries(spark, sf).select("l_orderkey", F.array_join("values", ";").alias("values"), "annotation_count", "status", "label", "eligible_main")


_STATUS = """CASE WHEN list_contains(v, 'N') THEN 'contains_unsure' WHEN len(v) = 1 THEN 'single_annotation'
        WHEN len(list_distinct(v)) = 1 THEN 'duplicate_agreement' ELSE 'duplicate_disagreement' END"""
_ENTRIES = f"""entries AS (
    SELECT l_orderkey, v, {_STATUS} AS status FROM (SELECT l_orderkey, list(l_returnflag ORDER BY l_linenumber, l_returnflag) AS v FROM lineitem GROUP BY l_orderkey)
), resolved AS (
    SELECT *, CASE WHEN status IN ('single_annotation', 'duplicate_agreement') THEN CASE v[1] WHEN 'A' THEN 1 WHEN 'R' THEN 0 END END AS label FROM entries
)"""

CONSENSUS_SQL = f"""WITH {_ENTRIES} SELECT l_orderkey, array_to_string(v, ';') AS values, CAST(len(v) AS INT) AS annotation_count, status, label,
    label IS NOT NULL AS eligible_main FROM resolved"""


def status_counts(spark, sf):
    return _entries(spark, sf).groupBy("status").agg(F.count("*").alias("n"), F.count("label").alias("eligible"), F.sum("label").alias("positives"))


STATUS_SQL = f"WITH {_ENTRIES} SELECT status, count(*) AS n, count(label) AS eligible, CAST(sum(label) AS BIGINT) AS positives FROM resolved GROUP BY status"


def _annotations(spark, sf):
    """Lines with two group columns and a label."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_suppkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.withColumn("label", labels.mapped_label(F.col("l_returnflag"), "A", "R"))


def label_distribution_grouping_sets(spark, sf):
    aggregates = labels.summary_columns(F.col("label"), F.col("l_returnflag"), "N")
    found = labels.distribution(_annotations(spark, sf), [[], ["o_orderstatus"], ["o_orderstatus", "o_orderpriority"]], *aggregates)
    return found.withColumn("positive_rate", rounded(F.col("positive_rate")))


DISTRIBUTION_SQL = """WITH a AS (
    SELECT *, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 0 END AS label FROM lineitem JOIN orders ON l_orderkey = o_orderkey
) SELECT o_orderstatus, o_orderpriority,
    CASE WHEN grouping(o_orderpriority) = 0 THEN 'o_orderstatus+o_orderpriority' WHEN grouping(o_orderstatus) = 0 THEN 'o_orderstatus' ELSE 'all' END AS level,
    count(*) AS rows, count(*) FILTER (label = 1) AS positive, count(*) FILTER (label = 0) AS negative, count(*) FILTER (l_returnflag = 'N') AS unsure,
    count(*) FILTER (label IS NULL AND l_returnflag IS DISTINCT FROM 'N') AS unknown,
    round(count(*) FILTER (label = 1) / nullif(count(label), 0)::DOUBLE, 9) AS positive_rate
FROM a GROUP BY GROUPING SETS ((), (o_orderstatus), (o_orderstatus, o_orderpriority))"""


def label_counts_by_columns(spark, sf):
    """Binary label counts for each of three group columns, in one pass."""
    found = labels.distribution(
        _annotations(spark, sf),
        [["o_orderstatus"], ["o_orderpriority"], ["l_linestatus"]],
        F.count_if(F.col("label") == 1).alias("positive"),
        F.count_if(F.col("label") == 0).alias("negative"),
    )
    return found.select("level", F.coalesce("o_orderstatus", "o_orderpriority", "l_linestatus").alias("value"), "positive", "negative")


COUNTS_SQL = """WITH a AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT 'o_orderstatus' AS level, o_orderstatus AS value, count(*) FILTER (l_returnflag = 'A') AS positive, count(*) FILTER (l_returnflag = 'R') AS negative FROM a GROUP BY 2
UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FILTER (l_returnflag = 'A'), count(*) FILTER (l_returnflag = 'R') FROM a GROUP BY 2
UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FILTER (l_returnflag = 'A'), count(*) FILTER (l_returnflag = 'R') FROM a GROUP BY 2"""


def duplicate_audit(spark, sf):
    return labels.duplicate_audit(table(spark, sf, "lineitem"), ["l_orderkey"], "l_returnflag", "l_suppkey")


AUDIT_SQL = """WITH p AS (SELECT count(*) AS n, count(DISTINCT l_suppkey) AS a, count(DISTINCT l_returnflag) AS v FROM lineitem GROUP BY l_orderkey)
SELECT count(*) AS keys, count(*) FILTER (n > 1) AS duplicate_keys, CAST(sum(CASE WHEN n > 1 THEN n - 1 ELSE 0 END) AS BIGINT) AS extra_rows,
    count(*) FILTER (n > 1 AND a > 1) AS several_annotators, count(*) FILTER (n > 1 AND v > 1) AS disagreements FROM p"""


def field_profile(spark, sf):
    found = labels.field_profile(table(spark, sf, "documents"), "text", "lang", "source", "n_chars")
    return found.withColumn("empty_rate", rounded(F.col("empty_rate")))


PROFILE_SQL = " UNION ALL ".join(
    f"""SELECT '{f}' AS field, count(*) AS rows, count(*) FILTER ({f} IS NULL OR {f}::VARCHAR = '') AS empty,
    count(DISTINCT nullif({f}::VARCHAR, '')) AS distinct_values, CAST(min(length(nullif({f}::VARCHAR, ''))) AS INT) AS min_length,
    CAST(max(length(nullif({f}::VARCHAR, ''))) AS INT) AS max_length, round(count(*) FILTER ({f} IS NULL OR {f}::VARCHAR = '') / count(*)::DOUBLE, 9) AS empty_rate FROM documents"""
    for f in ("text", "lang", "source", "n_chars")
)


def value_counts(spark, sf):
    return labels.value_counts(table(spark, sf, "events"), "event_type")


def distribution_stats(spark, sf):
    found = labels.distribution_stats(table(spark, sf, "documents"), "n_chars", "lang")
    return found.withColumns({c: rounded(F.col(c)) for c in ("median", "mean", "p95")})


STATS_SQL = """SELECT lang, count(n_chars) AS count, min(n_chars) AS min, round(quantile_cont(n_chars, 0.5), 9) AS median, round(avg(n_chars), 9) AS mean,
    round(quantile_cont(n_chars, 0.95), 9) AS p95, max(n_chars) AS max FROM documents GROUP BY lang"""


def wide_to_long_targets(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left")
    return labels.wide_to_long(rows, ["doc_id", "source"], {"quality": "quality", "toxic": "toxic"})


LONG_SQL = """SELECT doc_id, source, 'quality' AS target, quality AS label FROM documents JOIN labels USING (doc_id) WHERE quality IN (0, 1)
UNION ALL SELECT doc_id, source, 'toxic', toxic FROM documents JOIN labels USING (doc_id) WHERE toxic IN (0, 1)"""


def namespace_fold_rollup(spark, sf):
    """Customers by folded namespace: several nations count as one group, with subtotals."""
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    folded = nations.withColumn("group_name", F.when(F.col("r_name").isin("ASIA", "MIDDLE EAST"), "EAST").otherwise(F.col("r_name")))
    customers = table(spark, sf, "customer").join(folded, F.col("c_nationkey") == F.col("n_nationkey"))
    found = customers.rollup("group_name", "n_name").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("customers"))
    return found


ROLLUP_SQL = """SELECT CASE WHEN r_name IN ('ASIA', 'MIDDLE EAST') THEN 'EAST' ELSE r_name END AS group_name, n_name,
    CAST(grouping_id(CASE WHEN r_name IN ('ASIA', 'MIDDLE EAST') THEN 'EAST' ELSE r_name END, n_name) AS INT) AS level, count(*) AS customers
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY ROLLUP (CASE WHEN r_name IN ('ASIA', 'MIDDLE EAST') THEN 'EAST' ELSE r_name END, n_name)"""


def coverage_grid_zero_fill(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang")
    cells = docs.select("source").distinct().crossJoin(docs.select("lang").distinct())
    facts = docs.join(table(spark, sf, "labels"), "doc_id")
    return joins.grid(cells, facts, ["source", "lang"], labelled=F.count("*"), positive=F.count_if(F.col("toxic") == 1))


GRID_SQL = """SELECT s.source, l.lang, count(f.doc_id) AS labelled, count(*) FILTER (f.toxic = 1) AS positive
FROM (SELECT DISTINCT source FROM documents) s CROSS JOIN (SELECT DISTINCT lang FROM documents) l
LEFT JOIN (SELECT * FROM documents JOIN labels USING (doc_id)) f ON f.source = s.source AND f.lang = l.lang GROUP BY s.source, l.lang"""


def field_character_counts(spark, sf):
    s = F.col("steps")
    total = records(spark, sf).agg(*[F.sum(steps.characters(s, f)).alias(f) for f in ("action", "observation", "reasoning")])
    return total.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("characters")) for f in ("action", "observation", "reasoning")])))


CHARACTERS_SQL = " UNION ALL ".join(
    f"SELECT '{f}' AS field, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS characters FROM conversations WHERE role = '{r}'"
    for f, r in (("action", "assistant"), ("observation", "user"), ("reasoning", "system"))
)

QUERIES = {
    "steps_nested_features": (steps_nested_features, FEATURES_SQL),
    "step_lag_duplicates": (step_lag_duplicates, LAG_SQL),
    "last_nonempty_step": (last_nonempty_step, LAST_SQL),
    "termination_signals": (termination_signals, SIGNALS_SQL),
    "text_view_serialise": (text_view_serialise, VIEWS_SQL),
    "consensus_labels": (consensus_labels, CONSENSUS_SQL),
    "status_counts": (status_counts, STATUS_SQL),
    "label_distribution_grouping_sets": (label_distribution_grouping_sets, DISTRIBUTION_SQL),
    "label_counts_by_columns": (label_counts_by_columns, COUNTS_SQL),
    "duplicate_audit": (duplicate_audit, AUDIT_SQL),
    "field_profile": (field_profile, PROFILE_SQL),
    "value_counts": (value_counts, "SELECT event_type AS value, count(*) AS count FROM events GROUP BY event_type"),
    "distribution_stats": (distribution_stats, STATS_SQL),
    "wide_to_long_targets": (wide_to_long_targets, LONG_SQL),
    "namespace_fold_rollup": (namespace_fold_rollup, ROLLUP_SQL),
    "coverage_grid_zero_fill": (coverage_grid_zero_fill, GRID_SQL),
    "field_character_counts": (field_character_counts, CHARACTERS_SQL),
}
