"""Consensus labels of repeated annotations and label statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mapped_label(value: Column, positive: str, negative: str) -> Column:
    return F.when(value == positive, 1).when(value == negative, 0)


def collapsed(rows: DataFrame, *keys: str, value: str, order: str, unsure: str) -> DataFrame:
    """One row per key: values in encounter order, their status and the first one.

    Statuses: contains_unsure, single_annotation, duplicate_agreement,
    duplicate_disagreement.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value)))), lambda s: s[value])
    grouped = rows.groupBy(*keys).agg(ordered.alias("values"))
    values = F.col("values")
    status = (
        F.when(F.array_contains(values, unsure), "contains_unsure")
        .when(F.size(values) == 1, "single_annotation")
        .when(F.size(F.array_distinct(values)) == 1, "duplicate_agreement")
        .otherwise("duplicate_disagreement")
    )
    return grouped.withColumns({"annotation_count": F.size(values), "status": status, "first_value": F.get(values, F.lit(0))})


def resolved(entries: DataFrame, positive: str, negative: str) -> DataFrame:
    """``label`` (null unless all annotations agree on a class) and ``eligible_main``."""
    agreed = F.col("status").isin("single_annotation", "duplicate_agreement")
    label = F.when(agreed, mapped_label(F.col("first_value"), positive, negative))
    return entries.withColumn("label", label).withColumn("eligible_main", label.isNotNull())


def summary_columns(label: Column, value: Column, unsure: str) -> list[Column]:
    """Counts of positive, negative, unsure and unknown values, the valid ones and their positive rate."""
    positive, negative = F.count_if(label == 1), F.count_if(label == 0)
    return [
        F.count("*").alias("rows"),
        positive.alias("positive"),
        negative.alias("negative"),
        F.count_if(value == unsure).alias("unsure"),
        F.count_if(label.isNull() & ~(value.eqNullSafe(F.lit(unsure)))).alias("unknown"),
        F.try_divide(positive, positive + negative).alias("positive_rate"),
    ]


def distribution(rows: DataFrame, sets: list[list[str]], *aggregates: Column) -> DataFrame:
    """Aggregates over several grouping sets in one pass; ``level`` names the set."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in names])
    level = F.concat_ws("+", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in names])
    found = grouped.agg(F.when(F.length(level) == 0, "all").otherwise(level).alias("level"), *aggregates)
    return found


def duplicate_audit(rows: DataFrame, keys: list[str], value: str, annotator: str) -> DataFrame:
    """One row: keys, duplicated keys, extra rows, keys with several annotators, keys whose values disagree."""
    per = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_distinct(annotator).alias("annotators"), F.count_distinct(value).alias("values")
    )
    many = F.col("n") > 1
    return per.agg(
        F.count("*").alias("keys"),
        F.count_if(many).alias("duplicate_keys"),
        F.sum(F.when(many, F.col("n") - 1).otherwise(0)).alias("extra_rows"),
        F.count_if(many & (F.col("annotators") > 1)).alias("several_annotators"),
        F.count_if(many & (F.col("values") > 1)).alias("disagreements"),
    )


def field_profile(rows: DataFrame, *fields: str) -> DataFrame:
    """A row per field: rows, empty cells, their rate, distinct values, least and greatest length.

    All fields are measured in one pass; the wide result is then turned.
    """
    aggregates = []
    for f in fields:
        x = F.col(f).cast("string")
        empty = x.isNull() | (x == "")
        aggregates.append(
            F.struct(
                F.lit(f).alias("field"),
                F.count("*").alias("rows"),
                F.count_if(empty).alias("empty"),
                F.count_distinct(F.when(~empty, x)).alias("distinct_values"),
                F.min(F.when(~empty, F.char_length(x))).alias("min_length"),
                F.max(F.when(~empty, F.char_length(x))).alias("max_length"),
            ).alias(f)
        )
    wide = rows.agg(*aggregates)
    turned = wide.select(F.inline(F.array(*[F.col(f"`{f}`") for f in fields])))
    return turned.withColumn("empty_rate", F.try_divide(F.col("empty"), F.col("rows")))


def value_counts(rows: DataFrame, value: str) -> DataFrame:
    return rows.groupBy(F.col(value).alias("value")).count()


def distribution_stats(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """count, min, median, mean, p95 and max."""
    v = F.col(value)
    return rows.groupBy(*keys).agg(
        F.count(v).alias("count"),
        F.min(v).alias("min"),
        F.median(v).alias("median"),
        F.avg(v).alias("mean"),
        F.percentile(v, F.lit(0.95)).alias("p95"),
        F.max(v).alias("max"),
    )


def wide_to_long(rows: DataFrame, keys: list[str], targets: dict[str, str]) -> DataFrame:
    """(keys, target, label) with a row for each target whose label is 0 or 1."""
    pairs = F.array(*[F.struct(F.lit(t).alias("target"), F.col(c).cast("int").alias("label")) for t, c in targets.items()])
    return rows.select(*keys, F.inline(pairs)).where(F.col("label").isin(0, 1))
