"""Cluster bootstrap: draws, resampled metrics, intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.scalar import hash_bucket, stable_rank
from waymark.operators import metrics


def draws(groups: DataFrame, cell: str, group: str, n: int, seed: int) -> DataFrame:
    """(cell, bootstrap_id, draw_position, group, occurrence): groups drawn with replacement, as many as the cell has.

    The group at each position follows from a hash, so a draw can be made again
    anywhere. occurrence counts a group's turns within its draw.
    """
    order = Window.partitionBy(cell).orderBy(group)
    listed = groups.select(cell, group).distinct().withColumn("_at", F.row_number().over(order) - 1)
    sizes = listed.groupBy(cell).agg(F.count("*").cast("int").alias("_k"))
    slots = sizes.withColumn("bootstrap_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(
        "draw_position", F.explode(F.sequence(F.lit(0), F.col("_k") - 1))
    )
    rank = stable_rank(seed, "draw", F.col(cell).cast("string"), F.col("bootstrap_id").cast("string"), F.col("draw_position").cast("string"))
    picked = slots.withColumn("_at", hash_bucket(rank, 1 << 30) % F.col("_k"))
    named = picked.join(listed, [cell, "_at"])
    turn = Window.partitionBy(cell, "bootstrap_id", group).orderBy("draw_position")
    return named.withColumn("occurrence", F.row_number().over(turn) - 1).select(cell, "bootstrap_id", "draw_position", group, "occurrence")


def multiplicities(drawn: DataFrame, cell: str, group: str) -> DataFrame:
    return drawn.groupBy(cell, "bootstrap_id", group).agg(F.count("*").alias("times"))


def expanded(drawn: DataFrame, members: DataFrame, cell: str, group: str) -> DataFrame:
    """Every member of each drawn group, once for each time it was drawn."""
    return drawn.join(members, [cell, group])


def resampled_ranking(drawn: DataFrame, scored: DataFrame, cell: str, group: str, *keys: str) -> DataFrame:
    """Ranking metrics of (label, score) by (cell, keys, bootstrap_id).

    Members are reduced to counts per (group, score, label) and weighted by how
    often their group was drawn, instead of being copied.
    """
    counts = scored.groupBy(cell, *keys, group, "score", "label").agg(F.count("*").alias("_c"))
    weighted = counts.join(multiplicities(drawn, cell, group), [cell, group]).withColumn("_w", F.col("_c") * F.col("times"))
    return metrics.ranking(weighted, cell, *keys, "bootstrap_id", weight="_w")


def intervals(values: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, median, low, high, width, valid, invalid, valid_fraction) with the 2.5 and 97.5 percentiles of what is not null."""
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    found = values.groupBy(*keys).agg(q.alias("_q"), F.count(value).alias("valid"), F.count("*").alias("_n"))
    low, mid, high = (F.get(F.col("_q"), F.lit(i)) for i in range(3))
    return found.select(
        *keys,
        mid.alias("median"),
        low.alias("low"),
        high.alias("high"),
        (high - low).alias("width"),
        "valid",
        (F.col("_n") - F.col("valid")).alias("invalid"),
        (F.col("valid") / F.col("_n")).alias("valid_fraction"),
    )


def macro_draws(cells: DataFrame, value: str, *keys: str, least: int = 2) -> DataFrame:
    """(keys, value): the mean over cells of a draw, null with fewer than ``least`` valid cells."""
    mean = F.when(F.count(value) >= least, F.avg(value))
    return cells.groupBy(*keys).agg(mean.alias(value), F.count(value).alias("valid_cells"))


def paired_delta(values: DataFrame, value: str, method: str, a: str, b: str, *keys: str) -> DataFrame:
    """(keys, delta): a less b at equal keys, null where either is."""
    def of(m: str):
        return F.max(F.when(F.col(method) == m, F.col(value)))

    return values.where(F.col(method).isin(a, b)).groupBy(*keys).agg((of(a) - of(b)).alias("delta"))
