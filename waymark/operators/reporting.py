"""Registries, roll-ups, lineage and tables for reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def registry(parts: dict[str, DataFrame], id_column: str, value_column: str) -> DataFrame:
    """One typed table of evidence rows, each with the source it comes from and a stable id."""
    typed = [
        df.select(F.lit(name).alias("source"), F.col(id_column).cast("string").alias("item"), F.col(value_column).cast("double").alias("value"))
        for name, df in parts.items()
    ]
    rows = reduce(DataFrame.unionByName, typed)
    return rows.withColumn("evidence_id", F.substring(F.sha2(F.concat_ws("|", "source", "item"), 256), 1, 12))


def weighted_score(criteria: DataFrame, *keys: str) -> DataFrame:
    """Roll-up of 0..4 scores: the lower of two scores, weighted to 100, and capped."""
    sub = F.least("primary_score", "adversarial_score")
    raw = F.sum(F.col("weight") * sub / 4)
    cap = F.min(F.when(F.col("cap_triggered"), F.col("cap_value")))
    out = criteria.groupBy(*keys).agg(raw.alias("raw_score"), cap.alias("cap"))
    final = F.least("raw_score", F.coalesce(F.col("cap"), F.lit(100.0)))
    return out.withColumn("final_score", final)


def decision(validity: Column, core: Column, confirmed: Column, possible: Column, unresolved: Column) -> Column:
    """What a validity score, a core score (both 0..100) and risks allow.

    NO_GO: a confirmed critical risk, validity below 70 or core below 60; GO_WITH_MITIGATION: a possible
    critical risk, an unresolved major one, validity below 80 or core below 70; else GO. A null flag is false.
    """

    def told(flag: Column) -> Column:
        return F.coalesce(flag, F.lit(False))

    stop = told(confirmed) | (validity < 70) | (core < 60)
    mend = told(possible) | told(unresolved) | (validity < 80) | (core < 70)
    return F.when(stop, "NO_GO").when(mend, "GO_WITH_MITIGATION").otherwise("GO")


def run_summary(runs: DataFrame, method: str, phase: str, value: str) -> DataFrame:
    """(method, phase, runs, median, max) over measured runs."""
    return runs.groupBy(method, phase).agg(F.count("*").alias("runs"), F.median(value).alias("median"), F.max(value).alias("max"))


def pivot_ratio(summary: DataFrame, key: str, method: str, value: str, a: str, b: str) -> DataFrame:
    """(key, a, b, ratio): two methods side by side."""
    wide = summary.groupBy(key).pivot(method, [a, b]).agg(F.first(value))
    return wide.withColumn("ratio", F.try_divide(F.col(a), F.col(b)))


def fingerprint(rows: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with a digest of the canonical JSON of some columns, in name order, nulls included."""
    shaped = F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})
    return rows.withColumn("fingerprint", F.sha2(shaped, 256))


def markdown(rows: DataFrame, limit: int = 1000) -> str:
    """A small result as a Markdown table, with bars escaped."""
    head = rows.columns
    shown = [["NA" if v is None else str(v).replace("|", "\\|") for v in r] for r in rows.limit(limit).collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in [head, ["---"] * len(head), *shown]) + "\n"


def latex(rows: DataFrame, limit: int = 1000) -> str:
    """The rows of a LaTeX table, escaped."""
    marks = {c: f"\\{c}" for c in "&%$#_{}"} | {"\\": "\\textbackslash{}", "~": "\\textasciitilde{}", "^": "\\textasciicircum{}"}
    shown = [["NA" if v is None else "".join(marks.get(c, c) for c in str(v)) for v in r] for r in rows.limit(limit).collect()]
    return "".join(" & ".join(r) + " \\\\\n" for r in shown)
