"""Deterministic grouped splits and manifests."""

from __future__ import annotations

import hashlib
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.scalar import hash_bucket, stable_rank


def hash_folds(rows: DataFrame, group: str, n: int, seed: int, namespace: str) -> DataFrame:
    """``rows`` with ``fold``: groups stay whole; no shuffle is needed."""
    return rows.withColumn("fold", hash_bucket(stable_rank(seed, namespace, F.col(group)), n))


def cv_manifest(rows: DataFrame, n: int, fold: str = "fold") -> DataFrame:
    """Each row once per outer fold, as validation where it is its own and as train elsewhere."""
    outer = F.explode(F.array(*[F.lit(i) for i in range(n)])).alias("outer_fold")
    return rows.select("*", outer).withColumn("role", F.when(F.col(fold) == F.col("outer_fold"), "validation").otherwise("train"))


def leave_one_out(rows: DataFrame, group: str) -> DataFrame:
    """Each row once per group value held out; the groups' list is small and is broadcast by size."""
    held = rows.select(F.col(group).alias("held_out_group")).distinct()
    return rows.crossJoin(held).withColumn("role", F.when(F.col(group) == F.col("held_out_group"), "validation").otherwise("train"))


def shared_groups(manifest: DataFrame, cell: str, group: str) -> DataFrame:
    """(cell, group) with rows in train and in validation."""
    sides = manifest.groupBy(cell, group).agg(F.count_distinct("role").alias("roles"))
    return sides.where("roles > 1").select(cell, group)


def counterpart_rate(manifest: DataFrame, cell: str, group: str) -> DataFrame:
    """(cell, groups, with_counterpart, rate): validation groups that also occur in train."""
    train = manifest.where("role = 'train'").select(cell, group).distinct().withColumn("_seen", F.lit(1))
    held = manifest.where("role = 'validation'").select(cell, group).distinct()
    joined = held.join(train, [cell, group], "left").groupBy(cell)
    out = joined.agg(F.count("*").alias("groups"), F.count("_seen").alias("with_counterpart"))
    return out.withColumn("rate", F.col("with_counterpart") / F.col("groups"))


def fold_validity(manifest: DataFrame, key: str, label: str, n: int) -> DataFrame:
    """One row: keys that do not occur in all folds, or validate other than once; fold sides of one class only."""
    per_key = manifest.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("role") == "validation").alias("v"))
    bad_keys = per_key.agg(F.count_if(F.col("n") != n).alias("incomplete_keys"), F.count_if(F.col("v") != 1).alias("not_once_validated"))
    sides = manifest.groupBy("outer_fold", "role").agg(F.count_distinct(label).alias("classes"))
    return bad_keys.crossJoin(sides.agg(F.count_if(F.col("classes") < 2).alias("one_class_sides")))


def _rank(*parts: object) -> int:
    return int.from_bytes(hashlib.sha256("|".join(map(str, parts)).encode()).digest()[:8], "big")


class _Search:
    """Greedy assignments of groups (name -> negatives, positives) to ``n`` folds.

    How uneven folds are is a sum of squared distances from an even share: of each class over its total, of
    sizes over all rows (times 0.15) and of group numbers over all groups (times 0.05). The sums are kept as
    whole numbers over one denominator, so equal ones are equal.
    """

    def __init__(self, groups: dict[str, tuple[int, int]], n: int, seed: int, namespace: str) -> None:
        self.groups, self.n, self.seed, self.namespace = groups, n, seed, namespace
        self.totals = tuple(sum(g[k] for g in groups.values()) for k in (0, 1))
        rows = sum(self.totals)
        parts = (max(self.totals[0], 1), max(self.totals[1], 1), max(rows, 1), max(len(groups), 1))
        whole = 20 * parts[0] * parts[1] * parts[2] * parts[3]
        self.targets = (*self.totals, rows, len(groups))
        self.weights = tuple(whole * w // (20 * p) for w, p in zip((20, 20, 3, 1), parts, strict=True))

    def uneven(self, folds: list[list[int]]) -> int:
        return sum(w * (self.n * f[k] - t) ** 2 for f in folds for k, (w, t) in enumerate(zip(self.weights, self.targets, strict=True)))

    def start(self, salt: int) -> tuple[list[list[int]], dict[str, int]]:
        """(fold totals, fold of each group) of one start: rarest groups first, each to where it evens most."""
        n, groups, totals = self.n, self.groups, self.totals

        def order(name: str) -> tuple:
            neg, pos = groups[name]
            rarity = max(Fraction(neg, max(totals[0], 1)), Fraction(pos, max(totals[1], 1)))
            return -rarity, -(neg + pos), _rank(self.seed, self.namespace, salt, name)

        folds = [[0, 0, 0, 0] for _ in range(n)]
        placed: dict[str, int] = {}
        for i, name in enumerate(sorted(groups, key=order)):
            added = (*groups[name], sum(groups[name]), 1)
            # Every fold gets one of the first groups.
            open_ = [f for f in range(n) if not folds[f][3]] if i < n else range(n)

            def change(f: int, added: tuple = added) -> int:
                terms = zip(self.weights, self.targets, added, folds[f], strict=True)
                return sum(w * n * a * (n * a + 2 * (n * have - t)) for w, t, a, have in terms)

            changes = {f: change(f) for f in open_}
            least = min(changes.values())
            tied = [f for f in open_ if changes[f] == least]
            chosen = tied[0] if len(tied) == 1 else min(tied, key=lambda f: (_rank(self.seed, f"{self.namespace}|fold", salt, f"{name}|{f}"), f))
            placed[name] = chosen
            folds[chosen] = [x + a for x, a in zip(folds[chosen], added, strict=True)]
        return folds, placed

    def best(self, starts: int) -> dict[str, int] | None:
        """The most even of many starts whose folds, and what is left without each, have both classes; None if there is none."""
        if len(self.groups) < self.n or min(self.totals) < self.n:
            return None
        found = None
        for salt in range(starts):
            folds, placed = self.start(salt)
            if all(0 < f[k] < self.totals[k] for f in folds for k in (0, 1)):
                candidate = self.uneven(folds), tuple(sorted(placed.items()))
                found = candidate if found is None else min(found, candidate)
        return dict(found[1]) if found else None


def grouped_stratified(
    rows: DataFrame, namespace: str, group: str, label: str, candidates: int | tuple[int, ...], seed: int, starts: int = 512
) -> DataFrame:
    """``rows`` with ``n_folds`` and ``fold``: whole groups, with classes, sizes and group numbers as even as ``starts`` greedy starts get them.

    The first of the ``candidates`` (fold numbers, in the order given) is taken for which every fold and its
    complement have both classes; where none is feasible both columns are null. The search is sequential, so a
    namespace's groups (one row each, not their members) meet in one task; namespaces run in parallel.
    """
    numbers = (candidates,) if isinstance(candidates, int) else tuple(candidates)
    groups = rows.groupBy(F.col(namespace).alias("namespace"), F.col(group).alias("group")).agg(
        F.count_if(F.col(label) == 0).alias("negative"), F.count_if(F.col(label) == 1).alias("positive")
    )
    types = dict(groups.dtypes)

    def assign(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        held = {str(g): (int(neg), int(pos)) for g, neg, pos in found[["group", "negative", "positive"]].itertuples(index=False)}
        for n in numbers:
            placed = _Search(held, n, seed, str(key[0])).best(starts)
            if placed is not None:
                out = found[["namespace", "group"]]
                return out.assign(n_folds=n, fold=[placed[str(g)] for g in found["group"]])
        return found[["namespace", "group"]].assign(n_folds=0, fold=0).iloc[:0]

    schema = f"namespace {types['namespace']}, group {types['group']}, n_folds int, fold int"
    folds = groups.groupBy("namespace").applyInPandas(assign, schema)
    renamed = folds.select(F.col("namespace").alias(namespace), F.col("group").alias(group), "n_folds", "fold")
    return rows.join(renamed, [namespace, group], "left")


def nested_manifest(
    rows: DataFrame, target: str, group: str, label: str, seed: int, outer: tuple[int, ...] = (5, 4, 3), inner: tuple[int, ...] = (5, 4, 3, 2), starts: int = 512
) -> DataFrame:
    """``rows`` once for each outer fold of their target, with ``outer_fold``, ``outer_role``, ``inner_n`` and ``inner_split``.

    Inner folds are sought among the training rows of each outer fold alone; the first of them validates.
    """
    named = rows.withColumn("_outer", F.concat(F.lit("outer|"), F.col(target).cast("string")))
    placed = grouped_stratified(named, "_outer", group, label, outer, seed, starts).drop("_outer").where("fold IS NOT NULL")
    spread = placed.withColumn("outer_fold", F.explode(F.sequence(F.lit(0), F.col("n_folds") - 1)))
    spread = spread.withColumn("_inner", F.concat(F.lit("inner|"), F.col(target).cast("string"), F.lit("|outer"), (F.col("outer_fold") + 1).cast("string")))
    own = spread.drop("n_folds", "fold").columns
    train = spread.where(F.col("fold") != F.col("outer_fold")).select(*own)
    held = spread.where(F.col("fold") == F.col("outer_fold")).select(*own)
    cut = grouped_stratified(train, "_inner", group, label, inner, seed, starts)
    split = F.when(F.col("fold") == 0, "inner_validation").when(F.col("fold").isNotNull(), "inner_train")
    trained = cut.withColumns({"outer_role": F.lit("outer_train"), "inner_n": F.col("n_folds"), "inner_split": split})
    tested = held.withColumns({"outer_role": F.lit("outer_validation"), "inner_n": F.lit(None).cast("int"), "inner_split": F.lit("not_applicable")})
    names = [*[c for c in own if c != "_inner"], "outer_role", "inner_n", "inner_split"]
    return trained.select(*names).unionByName(tested.select(*names)).withColumn("outer_fold", F.col("outer_fold") + 1)
