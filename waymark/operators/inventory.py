"""Inventories of semi-structured JSON: paths, types, drift, roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from waymark.functions.scalar import first_match, redacted_node

# What the names in a path tell. Order decides between rules.
DIRECT_TERMS = (
    "success", "successful", "failure", "failed", "passed", "side_effect", "looping", "repetitiveness", "ground_truth_label",
    "annotation", "human_judgment", "judge_result", "reward", "score", "task_reward",
)
STRONG_PROXY_TERMS = (
    "evaluation", "evaluator", "judgment", "judgement", "verdict", "task_completed", "task_success", "done_status", "final_score",
)
IDENTITY_PATHS = ("$.agent", "$.benchmark", "$.experiment", "$.model")
NATURAL_TERMS = ("error", "completed", "finish", "final", "observation")
SUCCESS_TERMS = ("reward", "score", "success", "passed", "failure")
ROLES = (
    (("task", "intent", "instruction"), "task_instruction_or_metadata"),
    (("system",), "system_prompt"),
    (("reason", "thought"), "assistant_reasoning_or_visible_trace"),
    (("action",), "action"),
    (("tool",), "tool_call_or_result"),
    (("observation", "axtree"), "observation_or_environment_state"),
    (("final", "answer", "response"), "final_response_or_message"),
    (("timestamp", "time"), "timestamp"),
    (("token", "step"), "token_or_step_metadata"),
    (("model",), "model_metadata"),
    (("benchmark", "exp_name"), "benchmark_metadata"),
    (("screenshot", "image"), "screenshot_reference_or_payload"),
    (("reward", "score", "success", "judge", "annotation"), "outcome_or_judgment"),
)
# Which paths a cleaned record may use.
PERMANENT_TERMS = (
    "reward", "raw_reward", "score", "success", "successful", "passed", "failure", "side_effect", "looping", "repetitiveness",
    "annotation", "human_judgment", "judge_result", "ground_truth", "label",
)
IMAGE_TERMS = ("screenshot", "image_url", "base64")
METADATA_ROOTS = (
    "$.agent", "$.benchmark", "$.experiment", "$.model", "$.model_args", "$.package_version", "$.seed", "$.valid", "$.flags",
    "$.steps[].num", "$.steps[].open_pages_urls", "$.steps[].stats", "$.steps[].url",
)
PRIMARY_PATHS = (
    "$.goal", "$.steps", "$.steps[]", "$.steps[].action", "$.steps[].axtree_pruned", "$.steps[].focused_element",
    "$.steps[].last_action_error",
)
SENSITIVITY_PATH = "$.steps[].reasoning"
ERROR_PATH = "$.steps[].last_action_error"


def _any(lower: Column, terms: tuple[str, ...]) -> Column:
    return lower.rlike("|".join(terms))


def leakage(path: Column) -> Column:
    """struct<level, kind, affected, recommendation> of a path; null where nothing in it tells of outcomes."""
    lower = F.lower(path)
    every = "Success;Side Effect;Looping"

    def row(level: str, kind: str, affected: Column, recommendation: str) -> Column:
        names = ("level", "kind", "affected", "recommendation")
        return F.struct(*[v.alias(n) for n, v in zip(names, (F.lit(level), F.lit(kind), affected, F.lit(recommendation)), strict=True)])

    direct = F.when(_any(lower, SUCCESS_TERMS), F.lit("Success")).otherwise(F.lit(every))
    return (
        F.when(_any(lower, DIRECT_TERMS), row("level_1", "direct_label_or_official_outcome", direct, "exclude"))
        .when(_any(lower, STRONG_PROXY_TERMS), row("level_2", "strong_outcome_proxy", F.lit(every), "exclude"))
        .when(lower.isin(*IDENTITY_PATHS), row("level_3", "benchmark_or_agent_identity_shortcut", F.lit(every), "retain_with_ablation"))
        .when(_any(lower, NATURAL_TERMS), row("level_3", "natural_trajectory_outcome_information", F.lit(every), "retain_with_ablation"))
    )


def role(path: Column) -> Column:
    return first_match(F.lower(path), [("|".join(terms), name) for terms, name in ROLES], "unclassified")


def policy(path: Column) -> Column:
    """The class of a path: what a cleaned record may do with it; what nothing approves is for manual review."""
    lower = F.lower(path)
    banned = path.startswith("$.summary_info") | lower.rlike("(?<![a-z0-9_])(" + "|".join(PERMANENT_TERMS) + ")(?![a-z0-9_])")
    root = F.lit(False)
    for prefix in METADATA_ROOTS:
        root = root | (path == prefix) | path.startswith(prefix + ".") | path.startswith(prefix + "[]")
    return (
        F.when(banned | _any(lower, IMAGE_TERMS), "permanent_exclude")
        .when(root, "metadata_only")
        .when((path == SENSITIVITY_PATH) | path.startswith(SENSITIVITY_PATH + "."), "sensitivity_only")
        .when(path.isin(*PRIMARY_PATHS), "primary_input")
        .otherwise("manual_review")
    )


def field_policy(paths: DataFrame, path: str = "path") -> DataFrame:
    """``paths`` with ``policy`` and the views that include the field."""
    kind = policy(F.col(path))
    return paths.withColumn("policy", kind).withColumns(
        {
            "in_primary": F.col("policy") == "primary_input",
            "in_error_ablation": (F.col("policy") == "primary_input") & (F.col(path) != ERROR_PATH),
            "in_reasoning_sensitivity": F.col("policy").isin("primary_input", "sensitivity_only"),
        }
    )


_LONGEST_KEY = 64


def path_key(key: str) -> str:
    """A key as it stands in a path; keys that are data rather than names become ``{*}``."""
    plain = key.replace("_", "").replace("-", "")
    named = key[:1] == "_" or key[:1].isalpha()
    return key if key.isascii() and named and (not plain or plain.isalnum()) and len(key) <= _LONGEST_KEY else "{*}"


#: Objects whose keys are data whatever they look like.
_MAPS = (".bounding_boxes", ".extra_element_properties")


def walk(value: object, path: str = "$", key: str | None = None):
    """(path, type, scalar text, size, own key) of every node, keys in order; items of arrays share the path ``[]``."""
    if isinstance(value, dict):
        yield path, "dict", None, len(value), key
        for k in sorted(value):
            yield from walk(value[k], f"{path}.{'{*}' if path.endswith(_MAPS) else path_key(k)}", k)
    elif isinstance(value, list):
        yield path, "list", None, len(value), key
        for x in value:
            yield from walk(x, f"{path}[]")
    else:
        kind = "null" if value is None else type(value).__name__
        yield path, kind, value if kind == "str" else repr(value), None, key


@udtf(returnType="path string, kind string, value string, size int, key string")
class JsonPaths:
    """(path, kind, value, size, key) of every node of a JSON text; one row of kind ``invalid`` for what is none."""

    def eval(self, text: str):
        import json

        if text is None:
            return
        try:
            parsed = json.loads(text)
        except ValueError:
            yield "$", "invalid", None, None, None
            return
        yield from walk(parsed)


def paths(spark: SparkSession, rows: DataFrame, json_column: str, *kept: str) -> DataFrame:
    """(kept, path, kind, value, size, key): a row per node of each JSON text."""
    spark.udtf.register("waymark_json_paths", JsonPaths)
    rows.select(*kept, F.col(json_column).alias("_json")).createOrReplaceTempView("_waymark_json")
    names = "".join(f"t.`{k}`, " for k in kept)
    return spark.sql(f"SELECT {names}p.* FROM _waymark_json t, LATERAL waymark_json_paths(t._json) p")


def nested_keys(nodes: DataFrame, record: str) -> DataFrame:
    """(record, key): every key of a record's objects at any depth, lower-cased."""
    return nodes.where("key IS NOT NULL").select(record, F.lower("key").alias("key")).distinct()


def banned_keys(nodes: DataFrame, record: str, banned: tuple[str, ...]) -> DataFrame:
    """(record, key): keys at any depth that a cleaned record must not have."""
    return nested_keys(nodes, record).where(F.col("key").isin(*[b.lower() for b in banned]))


def screenshot_flags(nodes: DataFrame, record: str) -> DataFrame:
    """(record, has_screenshot_reference): whether a path of images holds something."""
    named = _any(F.lower("path"), ("screenshot", "image_url"))
    empty = (F.col("kind") == "null") | ((F.col("kind") == "str") & F.col("value").isin("", "REMOVED")) | ((F.col("kind") == "bool") & (F.col("value") == "False"))
    zero = F.col("kind").isin("int", "float") & (F.col("value").cast("double") == 0)
    return nodes.groupBy(record).agg(F.bool_or(named & ~empty & ~zero).alias("has_screenshot_reference"))


def inventory(nodes: DataFrame, key: str, *groups: str) -> DataFrame:
    """Presence and distinct records per (path, kind, groups), with the redacted value of the first record."""
    first = F.min_by(F.struct("value", "size"), key).alias("_first")
    found = nodes.groupBy("path", "kind", *groups).agg(F.count("*").alias("presence_count"), F.count_distinct(key).alias("record_count"), first)
    return found.withColumn("example", redacted_node(F.col("kind"), F.col("_first.value"), F.col("_first.size"))).drop("_first")


def drift(nodes: DataFrame, known: DataFrame, key: str, group: str) -> DataFrame:
    """(path, kind) pairs that a policy table does not know, with counts and the sorted groups they occur in."""
    new = nodes.join(known.select("path", "kind").distinct(), ["path", "kind"], "left_anti")
    groups = F.array_join(F.array_sort(F.collect_set(group)), ";")
    return new.groupBy("path", "kind").agg(
        F.count("*").alias("presence_count"), F.count_distinct(key).alias("record_count"), groups.alias("groups")
    )


def classified(nodes: DataFrame, path: str = "path") -> DataFrame:
    """``nodes`` with ``leakage_level``, ``leakage_kind``, ``role`` and ``policy`` of their path."""
    found = leakage(F.col(path))
    columns = {"leakage_level": found["level"], "leakage_kind": found["kind"], "role": role(F.col(path)), "policy": policy(F.col(path))}
    return nodes.withColumns(columns)
