"""Joins that account for every row, set checks and lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class IntegrityError(ValueError):
    """A contract between tables does not hold."""


def require_empty(violations: DataFrame, what: str) -> None:
    """Raise with a few examples if a table of violations has rows."""
    found = violations.limit(3).collect()
    if found:
        raise IntegrityError(f"{what}: {[r.asDict() for r in found]}")


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).count().where("count > 1")


def many_to_one(left: DataFrame, right: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """(joined, unmatched left rows); an error if the right keys are not unique."""
    require_empty(duplicate_keys(right, *keys), "right keys repeat")
    return left.join(right, list(keys)), left.join(right, list(keys), "left_anti")


def symmetric_difference(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """(keys, side): keys that only one side has."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    only_a = a.join(b, list(keys), "left_anti").withColumn("side", F.lit("left"))
    return only_a.unionByName(b.join(a, list(keys), "left_anti").withColumn("side", F.lit("right")))


def coverage(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """One row: keys on both sides and on one only (a full outer join that is counted)."""
    a = left.select(*keys).distinct().withColumn("_l", F.lit(1))
    b = right.select(*keys).distinct().withColumn("_r", F.lit(1))
    return a.join(b, list(keys), "full_outer").agg(
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("both"),
        F.count_if(F.col("_r").isNull()).alias("left_only"),
        F.count_if(F.col("_l").isNull()).alias("right_only"),
    )


def strict_three_way(facts: DataFrame, units: DataFrame, labels: DataFrame, key: str, *same: str) -> DataFrame:
    """facts with the columns of units and labels; an error on a lost row, a repeated key or unequal ``same`` columns."""
    require_empty(duplicate_keys(units, key), "unit keys repeat")
    require_empty(duplicate_keys(labels, key), "label keys repeat")
    require_empty(facts.join(units, key, "left_anti"), "facts without unit")
    require_empty(facts.join(labels, key, "left_anti"), "facts without label")
    renamed = units.withColumnsRenamed({c: f"_unit_{c}" for c in same})
    joined = facts.join(renamed, key).join(labels, key)
    unequal = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_unit_{c}")) for c in same], F.lit(False))
    require_empty(joined.where(unequal), "metadata differ")
    return joined.drop(*[f"_unit_{c}" for c in same])


def grid(cells: DataFrame, facts: DataFrame, keys: list[str], **zero_filled: Column) -> DataFrame:
    """Aggregates of facts for every cell of a grid, 0 where it has none."""
    found = facts.groupBy(*keys).agg(*[c.alias(n) for n, c in zero_filled.items()])
    joined = cells.join(found, keys, "left")
    return joined.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in zero_filled})


def exact_one(rows: DataFrame, **criteria: object):
    """The single row that equals all criteria."""
    hit = rows
    for name, value in criteria.items():
        hit = hit.where(F.col(name) == value)
    found = hit.limit(2).collect()
    if len(found) != 1:
        raise IntegrityError(f"{criteria}: {len(found)} rows")
    return found[0]


def mapped_files(units: DataFrame, files: DataFrame, *keys: str) -> DataFrame:
    """units with ``candidate_count`` and the only candidate's ``path``; null path for none or several."""
    counted = files.groupBy(*keys).agg(F.count("*").alias("candidate_count"), F.min("path").alias("_path"))
    joined = units.join(counted, list(keys), "left").withColumn("candidate_count", F.coalesce("candidate_count", F.lit(0)))
    return joined.withColumn("path", F.when(F.col("candidate_count") == 1, F.col("_path"))).drop("_path")


def with_fallback(rows: DataFrame, exact: DataFrame, loose: DataFrame, keys: list[str], loose_keys: list[str], value: str) -> DataFrame:
    """``value`` by all keys, else by the loose keys; ``match`` tells which."""
    by_all = exact.select(*keys, F.col(value).alias("_exact"))
    by_some = loose.select(*loose_keys, F.col(value).alias("_loose"))
    joined = rows.join(by_all, keys, "left").join(by_some, loose_keys, "left")
    match = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_loose").isNotNull(), "path_only").otherwise("none")
    return joined.withColumn(value, F.coalesce("_exact", "_loose")).withColumn("match", match).drop("_exact", "_loose")


def missing_references(rows: DataFrame, ids: str, key: str, target: DataFrame, target_key: str, separator: str = ";") -> DataFrame:
    """(key, missing): entries of a separated list that the target does not hold; blank entries do not count."""
    entry = F.explode(F.split(F.coalesce(F.col(ids), F.lit("")), separator)).alias("missing")
    listed = rows.select(key, entry).withColumn("missing", F.trim("missing")).where("missing <> ''")
    return listed.join(target.select(F.col(target_key).alias("missing")), "missing", "left_anti").select(key, "missing")


def compared(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row: compared and unpaired rows, rows with any unequal value and the greatest difference."""
    a = left.select(*keys, *[F.col(v).alias(f"_a_{v}") for v in values], F.lit(1).alias("_l"))
    b = right.select(*keys, *[F.col(v).alias(f"_b_{v}") for v in values], F.lit(1).alias("_r"))
    both = a.join(b, keys, "full_outer")
    unpaired = F.col("_l").isNull() | F.col("_r").isNull()
    unequal = reduce(lambda x, y: x | y, [~F.col(f"_a_{v}").eqNullSafe(F.col(f"_b_{v}")) for v in values])
    gap = F.greatest(*[F.coalesce(F.abs(F.col(f"_a_{v}") - F.col(f"_b_{v}")), F.lit(0.0)) for v in values], F.lit(0.0))
    return both.agg(
        F.count_if(~unpaired).alias("compared"),
        F.count_if(unpaired).alias("unpaired"),
        F.count_if(~unpaired & unequal).alias("unequal"),
        F.max(F.when(~unpaired, gap)).alias("max_difference"),
    )


def traced(rows: DataFrame, row_key: str) -> DataFrame:
    """``rows`` with ``criteria``: the map that a key like ``a=1|b=2`` writes."""
    return rows.withColumn("criteria", F.str_to_map(F.col(row_key), F.lit("\\|"), F.lit("=")))
