"""Classification metrics as relational aggregates over (keys, label, score, predicted).

Every operator takes the grouping columns; metrics of a cell whose labels are
all of one class are null, never imputed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _div(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def confusion(df: DataFrame, *keys: str, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """(keys, n, positives, tp, fp, fn, tn)."""

    def count(l: int, p: int) -> Column:
        return F.count_if((F.col(label) == l) & (F.col(predicted) == p))

    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(F.col(label) == 1).alias("positives"),
        count(1, 1).alias("tp"),
        count(0, 1).alias("fp"),
        count(1, 0).alias("fn"),
        count(0, 0).alias("tn"),
    )


def rates(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1, F2, specificity, false-positive rate, balanced accuracy and MCC of confusion counts.

    Zero divided by zero is 0 for precision, recall, F1, F2 and MCC, as no
    positive prediction is a failed one; two-class metrics are null in cells of
    one class.
    """
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    zero = F.lit(0.0)
    mixed = (F.col("positives") > 0) & (F.col("positives") < F.col("n"))
    recall, specificity = F.coalesce(_div(tp, tp + fn), zero), _div(tn, tn + fp)
    spread = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    two_class = {
        "precision": F.coalesce(_div(tp, tp + fp), zero),
        "recall": recall,
        "f1": F.coalesce(_div(2 * tp, 2 * tp + fp + fn), zero),
        "f2": F.coalesce(_div(5 * tp, 5 * tp + 4 * fn + fp), zero),
        "balanced_accuracy": (recall + specificity) / 2,
        "mcc": F.coalesce(_div(tp * tn - fp * fn, spread), zero),
    }
    out = counts.withColumns({k: F.when(mixed, v) for k, v in two_class.items()})
    return out.withColumns(
        {
            "specificity": specificity,
            "false_positive_rate": _div(fp, fp + tn),
            "predicted_positive_rate": _div(tp + fp, F.col("n")),
            "metric_status": F.when(mixed, F.lit("ok")).otherwise(F.lit("single_class")),
        }
    )


def _by_score(df: DataFrame, keys: tuple[str, ...], label: str, score: str, weight: str | None) -> DataFrame:
    w = F.col(weight) if weight else F.lit(1)
    return df.groupBy(*keys, F.col(score).alias("_score")).agg(F.sum(F.col(label) * w).alias("_tp"), F.sum(w).alias("_n"))


#: Ranges that scores between 0 and 1 are cut into; others fall into one below and one above.
RANGES = 1024


def _range(score: Column) -> Column:
    """A number that grows with the score, from a bounded set; null scores come last, as in a descending order."""
    inside = F.floor(score * RANGES).cast("int")
    placed = F.when(score.isNull(), F.lit(-2)).when(F.isnan(score) | (score > 1), F.lit(RANGES + 1)).when(score < 0, F.lit(-1))
    return placed.otherwise(inside)


def ranking(df: DataFrame, *keys: str, label: str = "label", score: str = "score", weight: str | None = None) -> DataFrame:
    """(keys, n, positives, prevalence, average_precision, ap_lift, roc_auc).

    Rows of equal score meet in one step: average precision sums precision
    times the gain in recall over distinct scores, and ties count half in
    ROC-AUC. Rows are reduced to one per score before any window; ``weight``
    counts a row several times, so resampled data need no copies of rows.
    Running sums are taken within ranges of scores and added to the totals of
    the ranges above, so no task sorts all scores of a cell.
    """
    steps = _by_score(df, keys, label, score, weight).withColumn("_range", _range(F.col("_score")))
    totals = steps.groupBy(*keys, "_range").agg(F.sum("_tp").alias("_tp"), F.sum("_n").alias("_n"))
    above = Window.partitionBy(*keys).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    names = {k: f"_key{i}" for i, k in enumerate((*keys, "_range"))}
    higher = totals.select(
        *[F.col(k).alias(n) for k, n in names.items()], *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("_tp", "_n")]
    )
    down = Window.partitionBy(*keys, "_range").orderBy(F.desc("_score")).rowsBetween(Window.unboundedPreceding, 0)
    within = steps.withColumns({"_tps": F.sum("_tp").over(down), "_ns": F.sum("_n").over(down)})
    same = F.lit(True)
    for k, n in names.items():
        same = same & F.col(k).eqNullSafe(F.col(n))
    run = within.join(higher, same).withColumns({"_tps": F.col("_tps") + F.col("_tp_above"), "_ns": F.col("_ns") + F.col("_n_above")})
    tp, n = F.col("_tp").cast("double"), F.col("_n").cast("double")
    # Negatives that rank below a score: all of them less those down to it.
    sums = run.groupBy(*keys).agg(
        F.sum("_n").alias("n"),
        F.sum("_tp").alias("positives"),
        F.sum(tp * F.col("_tps") / F.col("_ns")).alias("_ap"),
        F.sum((n - tp) * (F.col("_tps") - tp / 2)).alias("_above"),
    )
    mixed = (F.col("positives") > 0) & (F.col("positives") < F.col("n"))
    prevalence = _div(F.col("positives"), F.col("n"))
    ap = F.col("_ap") / F.col("positives")
    auc = F.col("_above") / (F.col("positives") * (F.col("n") - F.col("positives")))
    return sums.select(
        *keys,
        "n",
        "positives",
        prevalence.alias("prevalence"),
        F.when(mixed, ap).alias("average_precision"),
        F.when(mixed, ap - prevalence).alias("ap_lift"),
        F.when(mixed, auc).alias("roc_auc"),
    )


def bundle(df: DataFrame, *keys: str) -> DataFrame:
    """All metrics of (label, score, predicted) by ``keys``, with mean, median and greatest score."""
    scores = df.groupBy(*keys).agg(
        F.avg("score").alias("mean_probability"), F.median("score").alias("median_probability"), F.max("score").alias("max_probability")
    )
    counted = rates(confusion(df, *keys))
    ranked = ranking(df, *keys).drop("n", "positives")
    if not keys:
        return counted.crossJoin(ranked).crossJoin(scores)
    return counted.join(ranked, list(keys)).join(scores, list(keys))


def macro(cells: DataFrame, metric: str, *keys: str, condition: Column | None = None) -> DataFrame:
    """(keys, macro_mean, macro_std, n_cells, n_excluded): over cells whose metric is not null (and that fit)."""
    value = F.col(metric) if condition is None else F.when(condition, F.col(metric))
    return cells.groupBy(*keys).agg(
        F.avg(value).alias("macro_mean"),
        F.stddev_samp(value).alias("macro_std"),
        F.count(value).alias("n_cells"),
        F.count_if(value.isNull()).alias("n_excluded"),
    )


def delta_to_best(cells: DataFrame, metric: str, method: str, references: tuple[str, ...], *keys: str) -> DataFrame:
    """Each row's metric less the best of the reference methods in its cell; null where either is."""
    whole = Window.partitionBy(*keys)
    best = F.max(F.when(F.col(method).isin(*references), F.col(metric))).over(whole)
    return cells.withColumn("best_reference", best).withColumn("delta", F.col(metric) - best)


def delta_to_variant(cells: DataFrame, metric: str, variant: str, base: str, *keys: str) -> DataFrame:
    """Each variant's metric less that of the base variant in its cell."""
    whole = Window.partitionBy(*keys)
    value = F.max(F.when(F.col(variant) == base, F.col(metric))).over(whole)
    return cells.withColumn("base_value", value).withColumn("delta", F.col(metric) - value)


def retained_ratio(lift: Column, base: Column) -> Column:
    """How much of the base's lift a variant keeps: 0 where it has none, null without a positive base."""
    return F.when(base > 0, F.when(lift <= 0, F.lit(0.0)).otherwise(lift / base))


def dependency(ratio: Column, declines: Column, large_declines: Column, domains: Column) -> Column:
    """How much a target depends on what a variant leaves out.

    strong: less than half of the lift is kept, three quarters of the domains decline and two or more by
    0.05; moderate: 0.5 to 0.8 is kept and more than half of the domains decline; else limited.
    """
    strong = (ratio < 0.5) & (declines >= F.ceil(domains * 3 / 4)) & (large_declines >= 2)
    moderate = (ratio >= 0.5) & (ratio < 0.8) & (declines * 2 > domains)
    kind = F.when(strong, "strong_dependency").when(moderate, "moderate_dependency").otherwise("limited_dependency")
    return F.when(ratio.isNull(), "not_assessable_nonpositive_s0_ap_lift").otherwise(kind)


def variant_dependency(scored: DataFrame, variant: str, base: str, domain: str, *keys: str, sufficiency: tuple[str, ...] = ()) -> DataFrame:
    """(keys, variant, retained_ratio, domains, declines, large_declines, dependency) of (label, score) by variant.

    The ratio is of pooled lifts; declines are of average precision in domains that have both classes.
    The base is the ``reference``; variants that keep one part only get no grade of dependency.
    """
    pooled = delta_to_variant(ranking(scored, *keys, variant), "ap_lift", variant, base, *keys)
    by_domain = delta_to_variant(ranking(scored, *keys, domain, variant), "average_precision", variant, base, *keys, domain)
    counted = by_domain.groupBy(*keys, variant).agg(
        F.count("delta").alias("domains"),
        F.count_if(F.col("delta") < 0).alias("declines"),
        F.count_if(F.col("delta") <= -0.05).alias("large_declines"),
    )
    joined = pooled.join(counted, [*keys, variant]).withColumn("retained_ratio", retained_ratio(F.col("ap_lift"), F.col("base_value")))
    graded = dependency(F.col("retained_ratio"), F.col("declines"), F.col("large_declines"), F.col("domains"))
    kind = F.when(F.col(variant) == base, "reference").when(F.col(variant).isin(*sufficiency), "sufficiency_only_not_dependency_grade").otherwise(graded)
    return joined.select(*keys, variant, "retained_ratio", "domains", "declines", "large_declines", kind.alias("dependency"))


def signal_grades(pooled: DataFrame, folds: DataFrame, method: str, fold: str, dummies: tuple[str, ...], learned: tuple[str, ...], *keys: str) -> DataFrame:
    """(keys, grade) from metrics (average_precision, prevalence, f1) pooled and by fold.

    A learned method is better in average precision where that exceeds the prevalence, and in F1 where that
    exceeds the dummies' best. clear_provisional_signal: one is better in both, and in both at once in two or
    more folds; no_obvious_signal: none is better in either; else weak_or_mixed_signal.
    """

    def judged(rows: DataFrame, *cell: str) -> DataFrame:
        best = F.max(F.when(F.col(method).isin(*dummies), F.col("f1"))).over(Window.partitionBy(*cell))
        better = {"ap_better": F.col("average_precision") > F.col("prevalence"), "f1_better": F.col("f1") > best}
        told = rows.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in better.items()})
        return told.where(F.col(method).isin(*learned))

    improved = judged(folds, *keys, fold).groupBy(*keys, method).agg(F.count_if(F.col("ap_better") & F.col("f1_better")).alias("improved"))
    joined = judged(pooled, *keys).join(improved, [*keys, method], "left")
    clear = F.bool_or(F.col("ap_better") & F.col("f1_better") & (F.col("improved") >= 2))
    some = F.bool_or(F.col("ap_better") | F.col("f1_better"))
    grade = F.when(clear, "clear_provisional_signal").when(~some, "no_obvious_signal").otherwise("weak_or_mixed_signal")
    return joined.groupBy(*keys).agg(grade.alias("grade"))


def evidence_grade(low: Column, point: Column, valid_fraction: Column | None = None) -> Column:
    """confirmed: the interval lies above 0; directional: only the point does; else not_confirmed."""
    enough = F.lit(True) if valid_fraction is None else valid_fraction >= 0.95
    return F.when(enough & (low > 0), "confirmed").when(point > 0, "directional").otherwise("not_confirmed")
