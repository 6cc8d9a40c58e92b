"""Join, set and integrity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import scalar
from waymark.operators import inventory, joins, reporting, splits
from waymark.plans.base import PREDICTIONS, predictions, ranking_sql, rounded, table
from waymark.sources import files


def strict_join_scored(spark, sf):
    """Predictions with unit metadata and labels; no row may be lost and metadata must agree."""
    facts = predictions(spark, sf).where("method = 'B2' AND target = 'quality'").select("unit", "domain", "score", "predicted")
    units = table(spark, sf, "documents").select(F.col("doc_id").alias("unit"), F.col("lang").alias("domain"), "source")
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("unit"), "quality")
    joined = joins.strict_three_way(facts, units, labels, "unit", "domain")
    return joined.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("predicted") == F.col("quality")).alias("correct"))


STRICT_SQL = f"""WITH {PREDICTIONS} SELECT d.source, count(*) AS n, count(*) FILTER (p.predicted = l.quality) AS correct
FROM pred p JOIN documents d ON d.doc_id = p.unit AND d.lang = p.domain JOIN labels l ON l.doc_id = p.unit WHERE method = 'B2' AND target = 'quality' GROUP BY d.source"""


def unmatched_anti_join(spark, sf):
    """Annotations joined many to one; those without a partner are counted, not lost."""
    docs = table(spark, sf, "documents").select("doc_id", "source")
    joined, unmatched = joins.many_to_one(docs, table(spark, sf, "labels"), "doc_id")
    counted = joined.groupBy("source").agg(F.count("*").alias("n")).withColumn("matched", F.lit(True))
    return counted.unionByName(unmatched.groupBy("source").agg(F.count("*").alias("n")).withColumn("matched", F.lit(False)))


ANTI_SQL = """SELECT source, count(*) AS n, doc_id IN (SELECT doc_id FROM labels) AS matched FROM documents GROUP BY ALL"""


def key_universe_symdiff(spark, sf):
    """Customers without orders, and order numbers that no customer has."""
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"))
    orders = table(spark, sf, "orders").select(F.explode(F.array("o_custkey", "o_orderkey")).alias("key"))
    return joins.symmetric_difference(customers, orders, "key").groupBy("side").agg(F.count("*").alias("n"), F.min("key").alias("first_key"))


SYMDIFF_SQL = """WITH a AS (SELECT DISTINCT c_custkey AS key FROM customer), b AS (SELECT o_custkey AS key FROM orders UNION SELECT o_orderkey FROM orders)
SELECT side, count(*) AS n, min(key) AS first_key FROM (
    SELECT 'left' AS side, key FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'right', key FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
) GROUP BY side"""


def key_universe_coverage(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"))
    return joins.coverage(orders, table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key")), "key")


COVERAGE_SQL = """WITH a AS (SELECT DISTINCT o_orderkey AS k FROM orders), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem)
SELECT count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS both, count(*) FILTER (b.k IS NULL) AS left_only, count(*) FILTER (a.k IS NULL) AS right_only
FROM a FULL JOIN b ON a.k = b.k"""


def semi_join_counterparts(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "lang", F.concat_ws("::", "source", (F.col("doc_id") % 7).cast("string")).alias("grp"))
    found = splits.counterpart_rate(splits.leave_one_out(rows, "lang"), "held_out_group", "grp")
    return found.withColumn("rate", rounded(F.col("rate")))


COUNTERPART_SQL = """WITH d AS (SELECT lang, source || '::' || (doc_id % 7) AS grp FROM documents), h AS (SELECT DISTINCT lang AS held_out_group, grp FROM d)
SELECT held_out_group, count(*) AS groups, count(*) FILTER (seen) AS with_counterpart, round(count(*) FILTER (seen) / count(*)::DOUBLE, 9) AS rate
FROM (SELECT *, EXISTS (SELECT 1 FROM d WHERE d.grp = h.grp AND d.lang <> h.held_out_group) AS seen FROM h) GROUP BY held_out_group"""


def set_ops_union_intersect_except(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).where("k < 18")
    b = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")).where("k > 6")
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b)}
    out = None
    for name, df in parts.items():
        row = df.agg(F.lit(name).alias("operation"), F.count("*").alias("n"), F.sum("k").alias("total"))
        out = row if out is None else out.unionByName(row)
    return out


SETS_SQL = """WITH a AS (SELECT c_nationkey AS k FROM customer WHERE c_nationkey < 18), b AS (SELECT s_nationkey AS k FROM supplier WHERE s_nationkey > 6)
SELECT 'union' AS operation, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM (SELECT * FROM a UNION SELECT * FROM b)
UNION ALL SELECT 'intersect', count(*), CAST(sum(k) AS BIGINT) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT 'except', count(*), CAST(sum(k) AS BIGINT) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)"""


def exactly_once_membership(spark, sf):
    """Validation memberships of each unit over the folds held out."""
    rows = table(spark, sf, "documents").select("doc_id", "lang")
    manifest = splits.leave_one_out(rows, "lang").where("role = 'validation'")
    per = manifest.groupBy("doc_id").agg(F.count("*").alias("times"))
    return per.groupBy("times").agg(F.count("*").alias("units"))


ONCE_SQL = "SELECT CAST(1 AS BIGINT) AS times, count(DISTINCT doc_id) AS units FROM documents"


def list_fk_integrity(spark, sf):
    """Entries of separated id lists that do not exist."""
    doc = F.col("doc_id")
    rows = table(spark, sf, "documents").select(
        "doc_id", F.concat_ws(";", (doc % 50).cast("string"), F.lit(" "), (doc % 61).cast("string"), F.concat(F.lit(" "), (doc * 3 % 47).cast("string"))).alias("ids")
    )
    target = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("item"))
    return joins.missing_references(rows, "ids", "doc_id", target, "item")


FK_SQL = """WITH e AS (SELECT doc_id, trim(unnest(string_split((doc_id % 50) || '; ;' || (doc_id % 61) || '; ' || (doc_id * 3 % 47), ';'))) AS missing FROM documents)
SELECT doc_id, missing FROM e WHERE missing <> '' AND missing NOT IN (SELECT item_id::VARCHAR FROM benchmark)"""


def provenance_lookup(spark, sf):
    """Source cells found again through keys like ``lang=en|source=src1``."""
    docs = table(spark, sf, "documents").select("lang", "source", "n_chars")
    cells = docs.groupBy("lang", "source").agg(F.sum("n_chars").alias("value"))
    keyed = cells.select(F.concat(F.lit("lang="), "lang", F.lit("|source="), "source").alias("row_key"))
    traced = joins.traced(keyed, "row_key").select("row_key", F.col("criteria")["lang"].alias("lang"), F.col("criteria")["source"].alias("source"))
    return traced.join(cells, ["lang", "source"]).select("row_key", "value")


PROVENANCE_SQL = "SELECT 'lang=' || lang || '|source=' || source AS row_key, CAST(sum(n_chars) AS BIGINT) AS value FROM documents GROUP BY lang, source"


def domain_constraint_violations(spark, sf):
    """Rows that break a rule, with the rule's name."""
    rules = {
        "language_unknown": ~F.col("lang").isin("en", "fr", "de"),
        "count_differs": F.col("n_chars") != F.char_length("text"),
        "blank_text": scalar.blank_to_null(F.col("text")).isNull(),
        "too_long": F.col("n_chars") > 15000,
    }
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return table(spark, sf, "documents").select("doc_id", F.explode(names).alias("violation"))


VIOLATIONS_SQL = """SELECT doc_id, 'language_unknown' AS violation FROM documents WHERE lang NOT IN ('en', 'fr', 'de')
UNION ALL SELECT doc_id, 'count_differs' FROM documents WHERE n_chars <> length(text)
UNION ALL SELECT doc_id, 'blank_text' FROM documents WHERE text IS NULL OR regexp_full_match(text, '\\s*')
UNION ALL SELECT doc_id, 'too_long' FROM documents WHERE n_chars > 15000""".replace("\\\\", "\\")


def group_disjointness_check(spark, sf):
    """Groups on both sides of a split; none when folds follow the group."""
    rows = table(spark, sf, "documents").select("doc_id", "lang", "source")
    by_group = splits.cv_manifest(splits.hash_folds(rows, "source", 3, 7, "folds"), 3)
    by_row = splits.leave_one_out(rows, "lang")
    a = splits.shared_groups(by_group, "outer_fold", "source").agg(F.lit("by_group").alias("split"), F.count("*").alias("shared"))
    return a.unionByName(splits.shared_groups(by_row, "held_out_group", "source").agg(F.lit("by_language").alias("split"), F.count("*").alias("shared")))


DISJOINT_SQL = """WITH s AS (SELECT source, count(DISTINCT lang) AS langs, list(DISTINCT lang) AS l FROM documents GROUP BY source)
SELECT 'by_group' AS split, CAST(0 AS BIGINT) AS shared
UNION ALL SELECT 'by_language', count(*) FROM s, (SELECT DISTINCT lang FROM documents) h WHERE list_contains(s.l, h.lang) AND s.langs > 1"""


def file_mapping_candidates(spark, sf):
    """Units mapped to files by exact name; none or several candidates are flagged."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    stem = F.regexp_extract("url", r"://([^/?#]*)", 1)
    found = pages.select(stem.alias("stem"), F.col("url").alias("path"))
    units = table(spark, sf, "nation").select(F.lit("blog.tionsh.example.com").alias("stem"), F.col("n_nationkey").alias("unit"))
    units = units.unionByName(pages.select(stem.alias("stem"), F.col("page_id").cast("int").alias("unit")))
    units = units.unionByName(spark.range(1).select(F.lit("nowhere.example").alias("stem"), F.lit(-1).alias("unit")))
    return joins.mapped_files(units, found, "stem").select("unit", "stem", "candidate_count", "path")


MAPPING_SQL = """WITH f AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS stem, url AS path FROM pages), u AS (
    SELECT 'blog.tionsh.example.com' AS stem, n_nationkey AS unit FROM nation
    UNION ALL SELECT regexp_extract(url, '://([^/?#]*)', 1), CAST(page_id AS INT) FROM pages UNION ALL SELECT 'nowhere.example', -1
), c AS (SELECT stem, count(*) AS n, min(path) AS p FROM f GROUP BY stem)
SELECT unit, stem, coalesce(n, 0) AS candidate_count, CASE WHEN n = 1 THEN p END AS path FROM u LEFT JOIN c USING (stem)"""


def drift_policy_fallback(spark, sf):
    """Policies looked up by path and type, then by path only."""
    events = table(spark, sf, "events")
    rows = events.select(F.col("event_type").alias("path"), F.when(F.col("value") > 5, "number").otherwise("integer").alias("kind"))
    exact = spark.createDataFrame([("click", "number", "keep"), ("view", "integer", "drop"), ("error", "integer", "mask")], "path string, kind string, policy string")
    loose = spark.createDataFrame([("click", "review"), ("error", "review")], "path string, policy string")
    found = joins.with_fallback(rows, exact, loose, ["path", "kind"], ["path"], "policy")
    return found.groupBy("path", "kind", "policy", "match").agg(F.count("*").alias("n"))


POLICY_SQL = """WITH r AS (SELECT event_type AS path, CASE WHEN value > 5 THEN 'number' ELSE 'integer' END AS kind FROM events),
e(path, kind, policy) AS (VALUES ('click', 'number', 'keep'), ('view', 'integer', 'drop'), ('error', 'integer', 'mask')), l(path, policy) AS (VALUES ('click', 'review'), ('error', 'review')), c AS (SELECT path, kind, count(*) AS n FROM r GROUP BY path, kind)
SELECT c.path, c.kind, coalesce(e.policy, l.policy) AS policy, CASE WHEN e.policy IS NOT NULL THEN 'exact' WHEN l.policy IS NOT NULL THEN 'path_only' ELSE 'none' END AS match, n
FROM c LEFT JOIN e ON c.path = e.path AND c.kind = e.kind LEFT JOIN l ON c.path = l.path"""


def json_path_inventory(spark, sf):
    nodes = inventory.paths(spark, table(spark, sf, "events"), "props", "event_id", "event_type")
    found = inventory.classified(inventory.inventory(nodes, "event_id", "event_type"))
    return found


INVENTORY_SQL = """WITH n AS (
    SELECT event_type, event_id, '$' AS path, 'dict' AS kind, CAST(NULL AS VARCHAR) AS value FROM events
    UNION ALL SELECT event_type, event_id, '$.k', 'int', json_extract_string(props, '$.k') FROM events
) SELECT path, kind, event_type, count(*) AS presence_count, count(DISTINCT event_id) AS record_count,
    CASE WHEN kind = 'dict' THEN '<object:keys=1>' ELSE first(value ORDER BY event_id) END AS example,
    CAST(NULL AS VARCHAR) AS leakage_level, CAST(NULL AS VARCHAR) AS leakage_kind, 'unclassified' AS role, 'manual_review' AS policy FROM n GROUP BY path, kind, event_type"""


#: Paths with the policy, leakage level and role that the rules give them, worked by hand.
_PATHS = (
    ("$.goal", "primary_input", None, "unclassified"),
    ("$.steps[].action", "primary_input", None, "action"),
    ("$.steps[].last_action_error", "primary_input", "level_3", "action"),
    ("$.steps[].reasoning", "sensitivity_only", None, "assistant_reasoning_or_visible_trace"),
    ("$.steps[].reasoning.text", "sensitivity_only", None, "assistant_reasoning_or_visible_trace"),
    ("$.steps[].reasoningx", "manual_review", None, "assistant_reasoning_or_visible_trace"),
    ("$.steps[].screenshot", "permanent_exclude", None, "token_or_step_metadata"),
    ("$.steps[].url", "metadata_only", None, "token_or_step_metadata"),
    ("$.model", "metadata_only", "level_3", "model_metadata"),
    ("$.model_args.seed", "metadata_only", None, "model_metadata"),
    ("$.summary_info.n", "permanent_exclude", None, "unclassified"),
    ("$.Reward", "permanent_exclude", "level_1", "outcome_or_judgment"),
    ("$.cum_reward", "manual_review", "level_1", "outcome_or_judgment"),
    ("$.flags.evaluator", "metadata_only", "level_2", "unclassified"),
    ("$.task_name", "manual_review", None, "task_instruction_or_metadata"),
    ("$.finished", "manual_review", "level_3", "unclassified"),
)


def field_policy_classes(spark, sf):
    """Policy, leakage level and role of named paths, once for each region."""
    named = spark.createDataFrame([(p,) for p, *_ in _PATHS], "path string")
    rows = table(spark, sf, "region").select("r_regionkey").crossJoin(named)
    found = inventory.field_policy(rows).withColumns({"level": inventory.leakage(F.col("path"))["level"], "role": inventory.role(F.col("path"))})
    return found.select("r_regionkey", "path", "policy", "in_primary", "in_error_ablation", "in_reasoning_sensitivity", "level", "role")


def _quoted(value):
    return "NULL" if value is None else f"'{value}'"


CLASSES_SQL = f"""SELECT r_regionkey, path, policy, policy = 'primary_input' AS in_primary, policy = 'primary_input' AND path <> '$.steps[].last_action_error' AS in_error_ablation,
    policy IN ('primary_input', 'sensitivity_only') AS in_reasoning_sensitivity, level, role
FROM region, (VALUES {", ".join("(" + ", ".join(map(_quoted, row)) + ")" for row in _PATHS)}) p(path, policy, level, role)"""


def schema_drift(spark, sf):
    nodes = inventory.paths(spark, table(spark, sf, "events"), "props", "event_id", "event_type")
    known = spark.createDataFrame([("$", "dict")], "path string, kind string")
    return inventory.drift(nodes, known, "event_id", "event_type")


DRIFT_SQL = """SELECT '$.k' AS path, 'int' AS kind, count(*) AS presence_count, count(DISTINCT event_id) AS record_count,
    (SELECT string_agg(t, ';' ORDER BY t) FROM (SELECT DISTINCT event_type AS t FROM events)) AS groups FROM events"""


def resumable_state(spark, sf):
    """The state of a restarted build: known records keep theirs, new ones are pending."""
    current = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"))
    previous = table(spark, sf, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("failed").alias("state"))
    merged = files.merged_state(previous, current, "key", "state")
    todo = files.to_do(merged.select("key"), merged.where("state = 'done'"), "key").agg(F.count("*").alias("n")).withColumn("state", F.lit("to do"))
    return merged.groupBy("state").agg(F.count("*").alias("n")).unionByName(todo)


STATE_SQL = """WITH m AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'failed' END ELSE 'pending' END AS state FROM orders)
SELECT state, count(*) AS n FROM m GROUP BY state UNION ALL SELECT 'to do', count(*) FROM m WHERE state <> 'done'"""


def median_runs_ratio_pivot(spark, sf):
    """Medians over repeated runs, two methods side by side."""
    runs = table(spark, sf, "events").where("event_type IN ('click', 'view')").select(F.col("event_type").alias("method"), (F.col("user_id") % 6).cast("string").alias("phase"), "value")
    found = reporting.pivot_ratio(reporting.run_summary(runs, "method", "phase", "value"), "phase", "method", "median", "click", "view")
    return found.withColumns({c: rounded(F.col(c)) for c in ("click", "view", "ratio")})


RUNS_SQL = """WITH r AS (SELECT (user_id % 6)::VARCHAR AS phase, median(value) FILTER (event_type = 'click') AS click, median(value) FILTER (event_type = 'view') AS view FROM events GROUP BY 1)
SELECT phase, round(click, 9) AS click, round(view, 9) AS view, round(click / nullif(view, 0), 9) AS ratio FROM r"""


def weighted_score_rollup(spark, sf):
    part = table(spark, sf, "part")
    criteria = part.select(
        "p_brand",
        (F.col("p_partkey") % 5).cast("int").alias("primary_score"),
        (F.col("p_size") % 5).cast("int").alias("adversarial_score"),
        F.lit(1.0).alias("weight"),
        (F.col("p_size") > 45).alias("cap_triggered"),
        (F.col("p_size") + 20).cast("double").alias("cap_value"),
    )
    found = reporting.weighted_score(criteria, "p_brand")
    critical = F.when(F.col("cap") < 40, F.lit(True)).otherwise(F.lit(False))
    decided = found.withColumn("decision", reporting.decision(F.col("raw_score"), F.col("final_score"), critical, F.col("cap") < 60, F.lit(False)))
    return decided.withColumn("raw_score", rounded(F.col("raw_score"))).withColumn("final_score", rounded(F.col("final_score")))


SCORE_SQL = """WITH s AS (SELECT p_brand, sum(least(p_partkey % 5, p_size % 5) / 4.0::DOUBLE) AS raw_score, min(CASE WHEN p_size > 45 THEN (p_size + 20)::DOUBLE END) AS cap FROM part GROUP BY p_brand),
f AS (SELECT *, least(raw_score, coalesce(cap, 100)) AS final_score FROM s)
SELECT p_brand, round(raw_score, 9) AS raw_score, cap, round(final_score, 9) AS final_score, CASE WHEN coalesce(cap < 40, false) OR raw_score < 70 OR final_score < 60 THEN 'NO_GO'
    WHEN coalesce(cap < 60, false) OR raw_score < 80 OR final_score < 70 THEN 'GO_WITH_MITIGATION' ELSE 'GO' END AS decision FROM f"""


def evidence_registry(spark, sf):
    docs = table(spark, sf, "documents").groupBy("source").agg(F.avg("n_chars").alias("v"))
    customers = table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.sum("c_acctbal").alias("v"))
    parts = {"documents": docs.withColumnRenamed("source", "item"), "customers": customers.withColumnRenamed("c_mktsegment", "item")}
    return reporting.registry(parts, "item", "v").withColumn("value", F.round("value", 4))


REGISTRY_SQL = """WITH r AS (SELECT 'documents' AS source, source AS item, avg(n_chars) AS value FROM documents GROUP BY source
    UNION ALL SELECT 'customers', c_mktsegment, sum(c_acctbal) FROM customer GROUP BY c_mktsegment)
SELECT source, item, round(value, 4) AS value, substr(sha256(source || '|' || item), 1, 12) AS evidence_id FROM r"""


def method_evidence_join(spark, sf):
    """Point metric, best dummy and grade of each target, joined."""
    from waymark.operators import metrics

    scored = predictions(spark, sf)
    point = metrics.ranking(scored.where("method = 'B4'"), "target").select("target", "average_precision", "ap_lift")
    wins = metrics.ranking(scored.where("method = 'B4'"), "target", "domain").groupBy("target").agg(F.min("ap_lift").alias("least_lift"))
    graded = point.join(wins, "target").withColumn("grade", metrics.evidence_grade(F.col("least_lift"), F.col("ap_lift")))
    return graded.withColumns({c: rounded(F.col(c)) for c in ("average_precision", "ap_lift", "least_lift")})


EVIDENCE_SQL = f"""WITH {PREDICTIONS}, own AS (SELECT * FROM pred WHERE method = 'B4'), {ranking_sql("target", "own", "p")}, {ranking_sql("target, domain", "own", "d")},
w AS (SELECT target, min(ap_lift) AS least_lift FROM d GROUP BY target)
SELECT target, round(average_precision, 9) AS average_precision, round(ap_lift, 9) AS ap_lift, round(least_lift, 9) AS least_lift,
    CASE WHEN least_lift > 0 THEN 'confirmed' WHEN ap_lift > 0 THEN 'directional' ELSE 'not_confirmed' END AS grade FROM p JOIN w USING (target)"""

QUERIES = {
    "strict_join_scored": (strict_join_scored, STRICT_SQL),
    "unmatched_anti_join": (unmatched_anti_join, ANTI_SQL),
    "key_universe_symdiff": (key_universe_symdiff, SYMDIFF_SQL),
    "key_universe_coverage": (key_universe_coverage, COVERAGE_SQL),
    "semi_join_counterparts": (semi_join_counterparts, COUNTERPART_SQL),
    "set_ops_union_intersect_except": (set_ops_union_intersect_except, SETS_SQL),
    "exactly_once_membership": (exactly_once_membership, ONCE_SQL),
    "list_fk_integrity": (list_fk_integrity, FK_SQL),
    "provenance_lookup": (provenance_lookup, PROVENANCE_SQL),
    "domain_constraint_violations": (domain_constraint_violations, VIOLATIONS_SQL),
    "group_disjointness_check": (group_disjointness_check, DISJOINT_SQL),
    "file_mapping_candidates": (file_mapping_candidates, MAPPING_SQL),
    "drift_policy_fallback": (drift_policy_fallback, POLICY_SQL),
    "json_path_inventory": (json_path_inventory, INVENTORY_SQL),
    "schema_drift": (schema_drift, DRIFT_SQL),
    "field_policy_classes": (field_policy_classes, CLASSES_SQL),
    "resumable_state": (resumable_state, STATE_SQL),
    "median_runs_ratio_pivot": (median_runs_ratio_pivot, RUNS_SQL),
    "weighted_score_rollup": (weighted_score_rollup, SCORE_SQL),
    "evidence_registry": (evidence_registry, REGISTRY_SQL),
    "method_evidence_join": (method_evidence_join, EVIDENCE_SQL),
}
