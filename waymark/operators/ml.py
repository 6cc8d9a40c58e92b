"""Learners as aggregates where that is possible and as group kernels where it is not."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators import metrics, ranking, terms


def dummies(train: DataFrame, label: str, *keys: str) -> DataFrame:
    """(keys, most_frequent, prior): a hard 0/1 probability and the rate of positives."""
    rate = F.avg(F.col(label).cast("double"))
    return train.groupBy(*keys).agg(F.when(rate > 0.5, 1.0).otherwise(0.0).alias("most_frequent"), rate.alias("prior"))


def scaler(train: DataFrame, features: list[str]) -> DataFrame:
    """One row: mean and population standard deviation of each feature; 1 where it does not vary."""
    columns = []
    for f in features:
        sd = F.stddev_pop(f)
        columns += [F.avg(f).alias(f"{f}_mean"), F.when(sd == 0, 1.0).otherwise(sd).alias(f"{f}_sd")]
    return train.agg(*columns)


def scaled(rows: DataFrame, fitted: DataFrame, features: list[str]) -> DataFrame:
    """``rows`` with features in standard units; ``fitted`` is one row."""
    out = rows.crossJoin(F.broadcast(fitted))
    out = out.withColumns({f: (F.col(f) - F.col(f"{f}_mean")) / F.col(f"{f}_sd") for f in features})
    return out.drop(*[f"{f}_{s}" for f in features for s in ("mean", "sd")])


def without_accents(text: Column) -> Column:
    """Decomposed, without combining marks."""

    @F.pandas_udf("string")
    def strip(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else terms.plain(x))

    return strip(text)


def tfidf_variants(
    docs: DataFrame,
    key: str,
    text: str,
    variants: dict[str, int],
    min_df: int = 2,
    max_df: float = 1.0,
    max_features: int = 20_000,
    fit_on: str | None = None,
) -> DataFrame:
    """(key, term, weight, variant): :func:`tfidf` for several longest terms at once, by name."""
    rows = docs.select(key, F.lower(text).alias("_text"))
    taught = docs.where(F.col(fit_on)).select(key, F.lower(text).alias("_text")) if fit_on else rows
    whole = terms.gathered(rows)
    n = taught.count()
    found = terms.vocabularies(terms.gathered(taught) if fit_on else whole, set(variants.values()), min_df, max_df * n, max_features)
    idf = {name: {t: float(np.log((1 + n) / (1 + df)) + 1) for t, _, df, _ in found[longest]} for name, longest in variants.items()}
    return terms.weights(whole, idf, max(variants.values()))


def tfidf(
    docs: DataFrame, key: str, text: str, longest: int = 1, min_df: int = 2, max_df: float = 1.0, max_features: int = 20_000, fit_on: str | None = None
) -> DataFrame:
    """(key, term, weight): (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), scaled to length one by document.

    Terms are runs of 1 to ``longest`` words of two or more word characters (T1: 1, T2: 2) of the lower-cased text
    without accents. The vocabulary has the terms of at least ``min_df`` documents and of at most the share
    ``max_df`` of them; the most frequent ``max_features`` in the corpus (then by name) stay. With ``fit_on``, a
    boolean column, only the documents where it holds teach vocabulary and weights; all are transformed.
    """
    return tfidf_variants(docs, key, text, {"": longest}, min_df, max_df, max_features, fit_on).drop("variant")


def newton_logistic(x: np.ndarray, y: np.ndarray, c: float, balanced: bool, rounds: int = 100) -> tuple[np.ndarray, str]:
    """Weights (the last is the intercept, which is penalised too) of L2 logistic regression, and a status."""
    design = np.hstack([x, np.ones((len(x), 1))])
    weight = np.ones(len(y))
    if balanced:
        share = np.bincount(y, minlength=2)
        weight = (len(y) / (2 * share))[y]
    w = np.zeros(design.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -500, 500)))
        gradient = w + c * design.T @ (weight * (p - y))
        hessian = np.eye(len(w)) + c * (design.T * (weight * p * (1 - p))) @ design
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-10:
            return w, "converged"
    return w, "round limit"


Config = tuple[str, float, bool]


def fitted_scores(
    rows: DataFrame, tasks: list[str], key: str, features: list[str], label: str, role: str, configs: list[Config], config: str | None = None
) -> DataFrame:
    """(tasks, config, key, label, probability, status): the ``held`` rows of each task, scored by a model of its ``train`` rows.

    ``tasks`` are columns that tell the fits apart; every configuration is fitted for each of them, or only
    the one that the column ``config`` names. Statistics that scale the features come from the train rows
    alone. One fit sees its rows in one task, as small feature vectors; a task whose train rows have one class
    only gives no probability, and rows of other roles (or with a null label in train) are not used.
    """
    table = {name: (c, balanced) for name, c, balanced in configs}
    known = F.array(F.col(config)) if config else F.array(*[F.lit(name) for name in table])
    slim = rows.where(F.col(role).isin("train", "held")).select(*tasks, key, *features, label, F.col(role).alias("_role"), F.explode(known).alias("config"))
    types = dict(slim.dtypes)

    def run(task: tuple, found: pd.DataFrame) -> pd.DataFrame:
        c, balanced = table[task[-1]]
        held = found[found["_role"] == "held"]
        train = found[(found["_role"] == "train") & found[label].notna()].sort_values(key)
        x, y = train[features].to_numpy(float), train[label].to_numpy(int)
        out = held[[*tasks, "config", key, label]].assign(probability=np.nan, status="one class")
        if len(held) and len(set(y)) == 2:
            mean, sd = x.mean(axis=0), x.std(axis=0)
            sd[sd == 0] = 1
            w, status = newton_logistic((x - mean) / sd, y, c, balanced)
            z = np.hstack([(held[features].to_numpy(float) - mean) / sd, np.ones((len(held), 1))]) @ w
            out = out.assign(probability=1 / (1 + np.exp(-z)), status=status)
        return out

    schema = ", ".join(f"`{t}` {types[t]}" for t in (*tasks, "config", key, label)) + ", probability double, status string"
    scored = slim.groupBy(*tasks, "config").applyInPandas(run, schema)
    return scored.withColumn("probability", F.when(~F.isnan("probability"), F.col("probability")))


def out_of_fold(rows: DataFrame, key: str, features: list[str], label: str, fold: str, configs: list[Config], n_folds: int) -> DataFrame:
    """(key, config, outer_fold, probability, label, status): each fold's rows scored by a model of the other folds."""
    outer = F.explode(F.array(*[F.lit(k) for k in range(n_folds)])).alias("outer_fold")
    spread = rows.select("*", outer).withColumn("_side", F.when(F.col(fold) == F.col("outer_fold"), "held").otherwise("train"))
    found = fitted_scores(spread, ["outer_fold"], key, features, label, "_side", configs)
    return found.select(key, "config", "outer_fold", "probability", label, "status")


def nested(manifest: DataFrame, key: str, features: list[str], label: str, configs: list[Config], *targets: str) -> tuple[DataFrame, DataFrame]:
    """(outer scores, candidates) of nested selection over a manifest with ``outer_fold``, ``outer_role`` and ``inner_split``.

    For every target and outer fold each configuration is fitted on the inner train rows and judged by average
    precision on the inner validation rows; the best one (then the first in the order of ``configs``) is chosen,
    its threshold too. It is fitted again on all outer train rows and scores the outer validation rows, whose
    labels no step before has read.
    """
    cell = [*targets, "outer_fold"]
    inner = manifest.withColumn("_side", F.when(F.col("inner_split") == "inner_train", "train").when(F.col("inner_split") == "inner_validation", "held"))
    tried = fitted_scores(inner, cell, key, features, label, "_side", configs)
    judged = metrics.ranking(tried, *cell, "config", label=label, score="probability").select(*cell, "config", F.col("average_precision").alias("inner_ap"))
    place = F.array_position(F.array(*[F.lit(name) for name, _, _ in configs]), F.col("config"))
    candidates = judged.withColumn("rank", place)
    best = candidates.groupBy(*cell).agg(F.min_by("config", F.struct((-F.coalesce("inner_ap", F.lit(-1.0))).alias("a"), "rank")).alias("chosen"))
    limits = ranking.threshold_by_f1(tried.join(best, cell).where("config = chosen"), *cell, label=label, score="probability")
    outer = manifest.withColumn("_side", F.when(F.col("outer_role") == "outer_train", "train").when(F.col("outer_role") == "outer_validation", "held"))
    scored = fitted_scores(outer.join(best, cell), cell, key, features, label, "_side", configs, "chosen")
    final = scored.join(limits.select(*cell, "threshold"), cell, "left")
    marked = candidates.join(best, cell).withColumn("selected", F.col("config") == F.col("chosen")).drop("chosen")
    return final.withColumn("predicted", (F.col("probability") >= F.col("threshold")).cast("int")), marked


def leaked_keys(manifest: DataFrame, group: str, *targets: str) -> DataFrame:
    """(targets, outer_fold, group) on both sides of an outer fold, or of its inner one; fits are isolated where there is none."""
    cell = [*targets, "outer_fold", group]
    sides = manifest.groupBy(*cell).agg(
        F.count_distinct("outer_role").alias("outer"), F.count_distinct(F.when(F.col("inner_split") != "not_applicable", F.col("inner_split"))).alias("inner")
    )
    return sides.where("outer > 1 OR inner > 1").select(*cell)


def one_hot(rows: DataFrame, columns: dict[str, list[str]]) -> DataFrame:
    """Indicator columns ``name=value`` for given levels; an unknown level has none set."""
    return rows.withColumns({f"{c}={v}": F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)) for c, vs in columns.items() for v in vs})


def blind_predictions(scored: DataFrame, probability: str, threshold: str) -> DataFrame:
    """``predicted_label`` (inclusive threshold) and a check that probabilities are finite and within 0..1."""
    p = F.col(probability)
    sound = p.isNotNull() & ~F.isnan(p) & p.between(0, 1)
    return scored.withColumn("predicted_label", F.when(sound, (p >= F.col(threshold)).cast("int"))).withColumn(
        "inference_status", F.when(sound, "ok").otherwise("invalid")
    )
