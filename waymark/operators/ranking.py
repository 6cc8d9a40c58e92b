"""Selections with deterministic tie-breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def first_by(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each group in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def best_within(rows: DataFrame, keys: list[str], metric: str, tolerance: float, *order: Column) -> DataFrame:
    """Among rows within a tolerance of the group's best metric the first in ``order``."""
    near = rows.withColumn("_best", F.max(metric).over(Window.partitionBy(*keys))).where(F.col(metric) >= F.col("_best") - tolerance)
    return first_by(near.drop("_best"), keys, *order)


#: Candidate thresholds, in twentieths.
GRID = range(1, 20)


def threshold_by_f1(rows: DataFrame, *keys: str, label: str = "label", score: str = "score") -> DataFrame:
    """(keys, threshold, f1, recall): best F1, then recall, then nearness to 0.5, then the smaller threshold.

    Rows are first reduced to counts per score, so the 19 candidates multiply
    distinct scores and not rows.
    """
    by_score = rows.groupBy(*keys, F.col(score).alias("_score")).agg(F.sum(label).alias("_p"), F.count("*").alias("_n"))
    candidates = F.explode(F.array(*[F.lit(i) for i in GRID])).alias("_step")
    crossed = by_score.select("*", candidates).withColumn("threshold", F.col("_step") / 20)
    above = F.col("_score") >= F.col("threshold")
    sums = crossed.groupBy(*keys, "threshold").agg(
        F.sum(F.when(above, F.col("_p")).otherwise(0)).alias("tp"),
        F.sum(F.when(above, F.col("_n") - F.col("_p")).otherwise(0)).alias("fp"),
        F.sum(F.when(~above, F.col("_p")).otherwise(0)).alias("fn"),
    )
    zero = F.lit(0.0)
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), zero)
    recall = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), zero)
    scored = sums.withColumns({"f1": f1, "recall": recall})
    order = (F.desc("f1"), F.desc("recall"), F.abs(F.col("threshold") - 0.5), F.col("threshold"))
    return first_by(scored, list(keys), *order).select(*keys, "threshold", "f1", "recall")


def error_cases(rows: DataFrame, keys: list[str], case: str, score: str, threshold: str) -> DataFrame:
    """Per group the errors nearest to, in the lower middle of and farthest from the threshold.

    Ordered by distance, then key; among the farthest the smallest key wins.
    """
    distance = F.abs(F.col(score) - F.col(threshold))
    w = Window.partitionBy(*keys)
    placed = rows.withColumn("distance", distance).withColumns(
        {
            "_at": F.row_number().over(w.orderBy("distance", case)),
            "_before": F.lag("distance").over(w.orderBy("distance", case)),
            "_most": F.max("distance").over(w),
            "_n": F.count("*").over(w),
        }
    )
    # In one order: the farthest is the first row of the greatest distance.
    last = (F.col("distance") == F.col("_most")) & ~F.col("_before").eqNullSafe(F.col("distance"))
    nearest, middle, farthest = F.col("_at") == 1, F.col("_at") == F.floor((F.col("_n") - 1) / 2) + 1, last
    roles = F.array_compact(F.array(F.when(nearest, F.lit("nearest")), F.when(middle, F.lit("median")), F.when(farthest, F.lit("farthest"))))
    return placed.withColumn("selection", F.explode(roles)).drop("_at", "_before", "_most", "_n")


def best_and_worst(rows: DataFrame, keys: list[str], metric: str, name: str) -> DataFrame:
    """(keys, best, best_value, worst, worst_value); ties go to the first name."""
    present = rows.where(F.col(metric).isNotNull())
    return present.groupBy(*keys).agg(
        F.min_by(name, F.struct(-F.col(metric), F.col(name))).alias("best"),
        F.max(metric).alias("best_value"),
        F.min_by(name, F.struct(F.col(metric), F.col(name))).alias("worst"),
        F.min(metric).alias("worst_value"),
    )


def top_joined(rows: DataFrame, keys: list[str], name: str, order: list[Column], k: int) -> DataFrame:
    """(keys, top): the first ``k`` names, joined by semicolons."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k)
    listed = F.array_sort(F.collect_list(F.struct("_rank", name)))
    return ranked.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda s: s[name]), ";").alias("top"))


def coverage_fill(selected: list[dict], candidates: list[dict], wanted: list[tuple[str, object]], order: tuple[str, ...]) -> list[dict]:
    """Add, for each (field, value) in turn that no selected row has, the first candidate that has it.

    Sequential by nature: every addition may cover later wants. Both lists are
    the few rows of a probe.
    """
    out = list(selected)
    for field, value in wanted:
        if not any(r[field] == value for r in out):
            fitting = [c for c in candidates if c[field] == value and c not in out]
            out += sorted(fitting, key=lambda c: tuple(c[o] for o in order))[:1]
    return out


def selection_frequency(grid: DataFrame, chosen: DataFrame, *keys: str) -> DataFrame:
    """How often each configuration of a grid was chosen, 0 included."""
    counted = chosen.groupBy(*keys).agg(F.count("*").alias("times_selected"))
    return grid.join(counted, list(keys), "left").withColumn("times_selected", F.coalesce("times_selected", F.lit(0)))


