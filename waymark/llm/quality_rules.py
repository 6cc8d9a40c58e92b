"""Quality rules: decision lists learned by sequential covering.

Text statistics are DataFrame expressions. A bounded sample of labelled rows
goes to the driver, where rules (conjunctions of thresholds on the statistics)
are grown on one part of it, pruned on another and put in order; a third part
only measures the list. The list is applied to all rows as one conditional
expression.

Edge cases: a null or empty text has no words, zero statistics and fails the
base rules; texts of any length are measured whole, in memory in proportion to
one text; repeated rows get equal verdicts; a document labelled more than once
counts with its highest label, one whose doc_id repeats counts once (the row
with the greatest statistics); between conditions of equal gain the one of more
precision over all rows wins, then the last by (statistic, threshold); without labels (or with one class
only) the list is empty and rejects nothing; an empty table gives an empty one.
Input columns that bear the name of a result are replaced; all others pass.
"""

from __future__ import annotations

import bisect
import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import let, words

#: Ratios on which rules may test, by name, from the columns of with_statistics().
FEATURES = {
    "words": "CAST(n_words AS DOUBLE)",
    "mean_word_chars": "n_word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "upper_share": "n_upper / greatest(n_chars_all, 1)",
    "digit_share": "n_digits / greatest(n_chars_all, 1)",
}

STATISTICS = ("n_words", "n_word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_chars_all")

_POSITION = (1 << 31) - 1


def _repeated(sorted_items: Column, same) -> Column:
    """Items of a sorted array that equal a neighbour."""
    return F.filter(
        sorted_items,
        lambda x, k: F.coalesce(same(x, F.get(sorted_items, k + 1)), F.lit(False))
        | F.coalesce(same(x, F.get(sorted_items, k - 1)), F.lit(False)),
    )


def repeat_word_count(word_array: Column, width: int = 3) -> Column:
    """Words inside windows of ``width`` words that occur at least twice in the text.

    Window hashes share a long with the window's position; sorting these longs
    brings candidates together, and only candidates are compared word by word.
    """

    def packed(w: Column) -> Column:
        return F.sort_array(
            F.transform(
                F.sequence(F.lit(0), F.size(w) - width),
                lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(width)])
                .bitwiseAND(F.lit(~_POSITION))
                .bitwiseOR(i.cast("long")),
            )
        )

    def exact(w: Column, candidates: Column) -> Column:
        windows = F.sort_array(
            F.transform(
                candidates,
                lambda x: let(
                    x.bitwiseAND(F.lit(_POSITION)).cast("int"),
                    lambda i: F.struct(F.slice(w, i + 1, width).alias("w"), i.alias("i")),
                ),
            )
        )
        hits = let(windows, lambda s: _repeated(s, lambda a, b: a["w"] == b["w"]))
        return F.sort_array(F.transform(hits, lambda x: x["i"]))

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda p, k: F.least(F.lit(width), F.coalesce(F.get(starts, k + 1) - p, F.lit(width))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, x: total + x)

    def count(w: Column) -> Column:
        candidates = let(packed(w), lambda p: _repeated(p, lambda a, b: F.shiftright(a, 31) == F.shiftright(b, 31)))
        return let(
            candidates,
            lambda c: F.when(F.size(c) == 0, F.lit(0).cast("long")).otherwise(let(exact(w, c), covered)),
        )

    return F.when(F.size(word_array) <= width, F.lit(0).cast("long")).otherwise(let(word_array, count))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns STATISTICS (all long) of its text column."""
    t = F.coalesce(F.col(text), F.lit(""))

    def without(chars: str) -> Column:
        return (F.char_length(t) - F.char_length(F.regexp_replace(t, f"[{chars}]+", ""))).cast("long")

    keep = [c for c in docs.columns if c not in (*STATISTICS, "_wm_words", "_wm_lines")]
    split = docs.select(
        *keep,
        words(F.col(text)).alias("_wm_words"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_wm_lines"),
    )
    measured = F.struct(
        F.size("_wm_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_wm_words", "")).cast("long").alias("n_word_chars"),
        without("#*$%&|<>").alias("n_symbols"),
        F.size("_wm_lines").cast("long").alias("n_lines"),
        (F.size("_wm_lines") - F.size(F.array_distinct("_wm_lines"))).cast("long").alias("n_dup_lines"),
        repeat_word_count(F.col("_wm_words")).alias("n_repeat_words"),
        without("A-Z").alias("n_upper"),
        without("0-9").alias("n_digits"),
        F.char_length(t).cast("long").alias("n_chars_all"),
    )
    # A generator: filters on statistics are not pushed below it, where each would compute them again.
    return split.select(*keep, F.inline(F.array(measured)))


def base_failed(min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>' if self.above else '<='} {self.threshold!r}D"


@dataclass(frozen=True)
class Rule:
    """``precision`` (smoothed) and ``covered`` are of the rows that taught it."""

    conditions: tuple[Condition, ...]
    precision: float
    covered: int

    def sql(self) -> str:
        return " AND ".join(c.sql() for c in self.conditions)


@dataclass(frozen=True)
class DecisionList:
    """Ordered rejecting rules; a row that no rule fits is kept.

    held_out: (rejected, of these bad, rows, bad rows) of labelled rows that taught nothing.
    """

    rules: tuple[Rule, ...] = field(default=())
    held_out: tuple[int, int, int, int] = (0, 0, 0, 0)

    def sql(self) -> str:
        """The number of the first rule that fits (from 1) over the columns STATISTICS; null where none does."""
        if not self.rules:
            return "CAST(NULL AS INT)"
        return "CASE " + " ".join(f"WHEN {r.sql()} THEN {i}" for i, r in enumerate(self.rules, 1)) + " END"

    def rule(self) -> Column:
        return F.expr(self.sql())

    def rejects(self, values: dict[str, float]) -> bool:
        """The verdict over FEATURES given as numbers."""
        return any(all((values[c.feature] > c.threshold) == c.above for c in r.conditions) for r in self.rules)


class Covering:
    """Grows and prunes rules over ``(values, bad)`` rows; sets of rows are integers used as bit sets."""

    def __init__(self, rows: list[tuple[tuple[float, ...], bool]], names: tuple[str, ...], cuts: int) -> None:
        self.rows = rows = sorted(rows)
        n = len(rows)
        self.all = (1 << n) - 1
        self.bad = sum(1 << i for i, (_, b) in enumerate(rows) if b)
        # Rows are sorted by value, so every third one is a fair share of all values.
        self.growing = sum(1 << i for i in range(n) if i % 3)
        self.pruning = self.all & ~self.growing
        self.table: list[tuple[Condition, int]] = []
        for k, name in enumerate(names):
            values = sorted({v[k] for v, _ in rows})
            order = sorted(range(n), key=lambda i: rows[i][0][k])
            # Quantile cuts follow the bulk; evenly spaced cuts over the distinct values reach the tails.
            picks = {rows[order[(n - 1) * j // cuts]][0][k] for j in range(cuts)} if n else set()
            picks |= {values[(len(values) - 1) * j // cuts] for j in range(cuts)} if values else set()
            picks.discard(values[-1] if values else None)
            below, at = 0, 0
            for cut in sorted(picks):
                while at < n and rows[order[at]][0][k] <= cut:
                    below |= 1 << order[at]
                    at += 1
                edge = (cut + values[_after(values, cut)]) / 2
                self.table.append((Condition(name, False, edge), below))
                self.table.append((Condition(name, True, edge), self.all & ~below))

    def gain(self, before: int, after: int) -> float:
        """Information gained on the growing rows: bad rows kept, times the bits by which they stand out more."""
        p0, n0 = (before & self.bad & self.growing).bit_count(), (before & self.growing).bit_count()
        p1, n1 = (after & self.bad & self.growing).bit_count(), (after & self.growing).bit_count()
        return 0.0 if not p1 else p1 * (math.log2(p1 / n1) - math.log2(p0 / n0))

    def covered(self, conditions: list[tuple[Condition, int]], among: int) -> int:
        for _, mask in conditions:
            among &= mask
        return among

    def worth(self, cover: int) -> float:
        """Smoothed precision."""
        return ((cover & self.bad).bit_count() + 0.5) / (cover.bit_count() + 1)

    def grown(self, left: int, most: int) -> list[tuple[Condition, int]]:
        """Conditions by gain until no good growing row is covered, no condition gains or there are ``most``."""
        chosen: list[tuple[Condition, int]] = []
        cover = left
        while len(chosen) < most and cover & self.growing & ~self.bad:
            options = ((self.gain(cover, cover & c[1]), self.worth(cover & c[1]), c) for c in self.table)
            gain, _, best = max(options, key=lambda g: (g[0], g[1], g[2][0].feature, g[2][0].threshold), default=(0.0, 0.0, None))
            if best is None or gain <= 0:
                break
            chosen.append(best)
            cover &= best[1]
        return chosen

    def pruned(self, chosen: list[tuple[Condition, int]], left: int) -> list[tuple[Condition, int]]:
        """Without the conditions, last ones first, whose absence costs no precision on the pruning rows."""
        for c in reversed(list(chosen)):
            rest = [x for x in chosen if x is not c]
            if rest and self.worth(self.covered(rest, left & self.pruning)) >= self.worth(self.covered(chosen, left & self.pruning)):
                chosen = rest
        return chosen


def learn(
    rows: list[tuple[tuple[float, ...], bool]],
    names: tuple[str, ...] = tuple(FEATURES),
    cuts: int = 48,
    max_conditions: int = 4,
    max_rules: int = 12,
    min_precision: float = 0.95,
    max_error: float = 0.005,
    min_covered: int = 5,
) -> DecisionList:
    """Sequential covering over ``(values, bad)`` rows.

    Two thirds of the rows grow a rule, one third prunes it. The rule is
    accepted if, over all remaining rows, its smoothed precision reaches
    ``min_precision`` and at most ``max_error`` of what it covers is good; its
    rows are then removed and the next rule is grown. Where pruning went too far
    for that, the rule as it was grown is tried.
    """
    work = Covering(rows, names, cuts)

    def sound(cover: int) -> bool:
        n = cover.bit_count()
        return n >= min_covered and work.worth(cover) >= min_precision and (cover & ~work.bad).bit_count() <= max_error * n

    rules: list[Rule] = []
    left = work.all
    while len(rules) < max_rules and (left & work.bad & work.growing).bit_count() >= min_covered:
        grown = work.grown(left, max_conditions)
        tries = (work.pruned(grown, left), grown) if grown else ()
        chosen = next((c for c in tries if sound(work.covered(c, left))), None)
        if chosen is None:
            break
        cover = work.covered(chosen, left)
        rules.append(Rule(tuple(c for c, _ in chosen), work.worth(cover), cover.bit_count()))
        left &= ~cover
    return DecisionList(tuple(rules))


def measured(found: DecisionList, rows: list[tuple[tuple[float, ...], bool]], names: tuple[str, ...] = tuple(FEATURES)) -> DecisionList:
    """The list with its counts on rows that did not teach it."""
    verdicts = [(found.rejects(dict(zip(names, v, strict=True))), bad) for v, bad in rows]
    rejected = [bad for out, bad in verdicts if out]
    return replace(found, held_out=(len(rejected), sum(rejected), len(rows), sum(bad for _, bad in rows)))


def _after(values: list[float], cut: float) -> int:
    return min(bisect.bisect_right(values, cut), len(values) - 1)


def learn_from_labels(docs: DataFrame, labels: DataFrame, max_labelled: int = 12_000, held_out: int = 5) -> DecisionList:
    """A decision list from the documents that ``labels`` (doc_id, quality) covers.

    ``max_labelled`` bounds the sample of labelled rows: those whose doc_id has
    the smallest hashes. Only that sample, a row for each doc_id, leaves the
    executors. One in ``held_out`` of its rows, by another hash, measures the
    list and does not teach it. Documents that fail the base rules teach
    nothing, as they are rejected without the list.
    """
    sample = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("quality").alias("_quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )
    # At most max_labelled pairs of a long and an int, whatever the input: small enough to broadcast.
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    values = F.struct(*[F.expr(e).cast("double").alias(n) for n, e in FEATURES.items()])
    rows = with_statistics(chosen).where(~base_failed()).groupBy("doc_id").agg(F.max(values).alias("v"), F.max("_quality").alias("q"))
    part = F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(held_out)) == 0
    taught, kept_back = [], []
    for v, q, apart in rows.select("v", "q", part).collect():
        (kept_back if apart else taught).append((tuple(v), q == 0))
    return measured(learn(taught), kept_back)


def judged(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """``docs`` with STATISTICS, ``base_failed``, ``rule`` (the number of the rule that rejects, or null) and ``kept``."""
    plain = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("base_failed", "rule", "kept")])
    failed = with_statistics(plain).withColumns({"base_failed": base_failed(), "rule": rules.rule()})
    return failed.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
