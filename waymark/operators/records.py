"""Cleaned records, contracts on prediction rows, variants, and stored models."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import steps as step_functions
from waymark.functions.scalar import blank_to_null

#: The step fields that a cleaned record keeps; all others are dropped, and those that are not there are null.
STEP_FIELDS = ("action", "observation", "error", "reasoning", "focused_element", "tool_name", "tool_input", "tool_output")


def cleaned(raw: DataFrame, steps: str = "steps", instruction: str = "instruction") -> DataFrame:
    """``raw`` with whitelisted, numbered steps, a ``terminal`` struct and ``quality_flags``; blank texts become null."""

    there = raw.schema[steps].dataType.elementType.fieldNames()

    def step(s: Column, i: Column) -> Column:
        fields = [(blank_to_null(s[f]) if f in there else F.lit(None).cast("string")).alias(f) for f in STEP_FIELDS]
        return F.struct((i + 1).cast("int").alias("step_index"), *fields)

    kept = raw.withColumn(steps, F.transform(F.coalesce(F.col(steps), F.array()), step)).withColumn(instruction, blank_to_null(F.col(instruction)))
    s = F.col(steps)

    def any_of(name: str) -> Column:
        return F.exists(s, lambda x: x[name].isNotNull())

    terminal = F.struct(
        step_functions.last_nonempty(s, "action").alias("last_nonempty_action"),
        step_functions.last_nonempty(s, "observation").alias("last_nonempty_observation"),
        step_functions.last_step_index(s).alias("last_step_index"),
    )
    flags = F.struct(
        F.col(instruction).isNotNull().alias("has_task_instruction"),
        (F.size(s) > 0).alias("has_steps"),
        any_of("action").alias("has_action"),
        any_of("observation").alias("has_observation"),
        any_of("reasoning").alias("has_reasoning"),
        any_of("error").alias("has_natural_error"),
    )
    return kept.withColumn("terminal", terminal).withColumn("quality_flags", flags)


def bundles(clean: DataFrame, key: str, steps: str = "steps", instruction: str = "instruction") -> DataFrame:
    """(key, view, text, content_sha256, characters): every text view of cleaned records."""

    def one(view: str) -> Column:
        text = step_functions.text_view(F.col(instruction), F.col(steps), view)
        return F.struct(F.lit(view).alias("view"), text.alias("text"))

    shown = clean.select(key, F.inline(F.array(*[one(v) for v in step_functions.VIEWS])))
    return shown.withColumns({"content_sha256": F.sha2("text", 256), "characters": F.char_length("text").cast("long")})


def allowed(rows: DataFrame, column: str, values: tuple[str, ...], names: dict[str, str]) -> DataFrame:
    """The rows whose ``column`` is one of ``values``, with the columns ``names`` (new name by old one) and no other."""
    return rows.where(F.col(column).isin(*values)).select(*[F.col(f"`{old}`").alias(new) for old, new in names.items()])


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, violation): a row for each rule (a condition that must not hold) that a row breaks; null does not break."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return rows.select(key, F.explode(names).alias("violation"))


def prediction_rules() -> dict[str, Column]:
    """What prediction rows must not be: (trajectory_key, group_key, held_out_group, true_label, predicted_probability, selected_threshold, predicted_label)."""
    p = F.col("predicted_probability")
    expected = (p >= F.col("selected_threshold")).cast("int")
    return {
        "key_outside_group": ~F.startswith("trajectory_key", F.concat("group_key", F.lit("::"))),
        "group_outside_fold": F.get(F.split("group_key", "::"), F.lit(0)) != F.col("held_out_group"),
        "probability_range": p.isNull() | F.isnan(p) | ~p.between(0, 1),
        "label_not_binary": ~F.coalesce(F.col("true_label").isin(0, 1), F.lit(False)),
        "label_not_by_threshold": F.col("predicted_label") != expected,
    }


def consistent_variants(rows: DataFrame, keys: list[str], *fields: str) -> DataFrame:
    """(keys, fields): groups whose repeated fields agree; groups with differing values are left out."""
    agree = rows.groupBy(*keys).agg(*[F.count_distinct(f).alias(f"_n_{f}") for f in fields], *[F.first(f, True).alias(f) for f in fields])
    for f in fields:
        agree = agree.where(F.col(f"_n_{f}") <= 1)
    return agree.select(*keys, *fields)


def variant_grid(spark: SparkSession, variants: dict[str, list[str]], features: list[str]) -> DataFrame:
    """(variant, feature, position, included): every feature of every variant, in contract order."""
    rows = [(v, f, i, f in chosen) for v, chosen in variants.items() for i, f in enumerate(features)]
    return spark.createDataFrame(rows, "variant string, feature string, position int, included boolean")


def support(scored: DataFrame, *keys: str) -> DataFrame:
    """Rows, positives, groups and groups with a positive: how well a sparse target is supported."""
    return scored.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        F.sum("label").alias("positives"),
        F.count_distinct("group_key").alias("groups"),
        F.count_distinct(F.when(F.col("label") == 1, F.col("group_key"))).alias("positive_groups"),
    )


def status_text(status: Column) -> Column:
    """Section, priority and wording that a status allows."""

    def row(section: str, priority: int, forbidden: str) -> Column:
        return F.struct(F.lit(section).alias("section"), F.lit(priority).alias("priority"), F.lit(forbidden).alias("forbidden"))

    return (
        F.when(status == "confirmed", row("results", 1, "proves"))
        .when(status == "directional", row("results", 2, "confirms"))
        .otherwise(row("limitations", 3, "shows"))
    )


def latest(*values: Column) -> Column:
    """The first value that is not blank, or an empty text."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


@dataclass(frozen=True)
class LinearModel:
    """Weights by feature, with the statistics that scaled them."""

    features: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    intercept: float

    def probability(self) -> Column:
        """Positive-class probability over the feature columns."""
        z = F.lit(self.intercept)
        for f, m, s, w in zip(self.features, self.mean, self.scale, self.weights, strict=True):
            z = z + (F.col(f) - m) / s * w
        return 1 / (1 + F.exp(-z))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = list(zip(range(len(self.features)), self.features, self.mean, self.scale, self.weights, strict=True))
        rows.append((len(rows), "(intercept)", 0.0, 1.0, self.intercept))
        frame = spark.createDataFrame(rows, "position int, feature string, mean double, scale double, weight double")
        frame.coalesce(1).write.mode("errorifexists").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> LinearModel:
        rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r.position)
        body = rows[:-1]
        return LinearModel(
            tuple(r.feature for r in body), tuple(r["mean"] for r in body), tuple(r["scale"] for r in body), tuple(r.weight for r in body), rows[-1].weight
        )

    def coefficients(self, spark: SparkSession) -> DataFrame:
        """(feature, coefficient, rank): by magnitude, then name."""
        ranked = sorted(zip(self.features, self.weights, strict=True), key=lambda fw: (-abs(fw[1]), fw[0]))
        return spark.createDataFrame([(f, w, i + 1) for i, (f, w) in enumerate(ranked)], "feature string, coefficient double, rank int")


def probability_digest(rows: DataFrame, key: str, probability: str, *keys: str) -> DataFrame:
    """(keys, digest): SHA-256 over the little-endian doubles of a group, in key order.

    A digest runs over its values in order, so a group is read by one task; it is read as a stream.
    """
    names = [*keys, "digest"]
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, types = None, None, []

        def closed() -> pa.RecordBatch:
            cells = [pa.array([v], t) for v, t in zip((*now, digest.hexdigest()), types, strict=True)]
            return pa.RecordBatch.from_arrays(cells, names)

        for batch in batches:
            types = [*batch.schema.types[: len(keys)], pa.string()]
            cells = list(zip(*[batch.column(i).to_pylist() for i in range(len(keys))], strict=True)) or [()] * batch.num_rows
            values = batch.column(len(keys)).to_numpy(zero_copy_only=False).astype("<f8")
            at = 0
            for i in range(1, len(cells) + 1):
                if i == len(cells) or cells[i] != cells[at]:
                    if cells[at] != now:
                        if digest is not None:
                            yield closed()
                        now, digest = cells[at], hashlib.sha256()
                    digest.update(values[at:i].tobytes())
                    at = i
        if digest is not None:
            yield closed()

    ordered = rows.repartition(*keys) if keys else rows.coalesce(1)
    slim = ordered.sortWithinPartitions(*keys, key).select(*keys, F.col(probability).cast("double"))
    return slim.mapInArrow(run, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "digest string"]))
