"""Functions on the array of steps of a record: array<struct<step_index, action, observation, ...>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions.binding import let
from waymark.functions.scalar import blank_to_null, collapse


def _present(steps: Column, name: str) -> Column:
    return F.filter(steps, lambda s: blank_to_null(s[name]).isNotNull())


def characters(steps: Column, name: str) -> Column:
    """Characters of a field over the steps, as the texts are."""
    return F.aggregate(steps, F.lit(0).cast("long"), lambda t, s: t + F.coalesce(F.char_length(s[name]), F.lit(0)))


def normal_actions(steps: Column) -> Column:
    """Non-empty actions with white space collapsed, in order."""
    return F.transform(_present(steps, "action"), lambda s: collapse(s["action"]))


def repeats(items: Column) -> Column:
    """How many items equal the one before."""
    pairs = let(items, lambda a: F.filter(a, lambda x, i: (i > 0) & (x == F.get(a, i - 1))))
    return F.size(pairs).cast("long")


def last_nonempty(steps: Column, name: str) -> Column:
    return F.get(F.reverse(F.transform(_present(steps, name), lambda s: s[name])), F.lit(0))


def last_step_index(steps: Column) -> Column:
    return F.array_max(F.transform(steps, lambda s: s["step_index"]))


def structural_features(steps: Column, signal: Column) -> dict[str, Column]:
    """The structural features by name, in contract order; ratios of nothing are 0.

    Character totals count the texts that are not blank, with the white space at
    their ends; means divide them by the number of these texts.
    """
    zero = F.lit(0.0)
    n = F.size(steps).cast("long")
    actions = F.size(_present(steps, "action")).cast("long")
    observations = F.size(_present(steps, "observation")).cast("long")
    errors = F.size(_present(steps, "error")).cast("long")
    said, seen = characters(_present(steps, "action"), "action"), characters(_present(steps, "observation"), "observation")
    unique = let(normal_actions(steps), lambda a: F.try_divide(F.size(F.array_distinct(a)), F.size(a)))
    return {
        "step_count": n,
        "nonempty_action_count": actions,
        "nonempty_observation_count": observations,
        "nonempty_focused_element_count": F.size(_present(steps, "focused_element")).cast("long"),
        "natural_error_step_count": errors,
        "natural_error_step_ratio": F.coalesce(F.try_divide(errors, n), zero),
        "has_explicit_termination_signal": F.when(blank_to_null(signal).isNotNull(), 1).otherwise(0),
        "action_char_count_total": said,
        "observation_char_count_total": seen,
        "action_char_count_mean_nonempty": F.coalesce(F.try_divide(said, actions), zero),
        "observation_char_count_mean_nonempty": F.coalesce(F.try_divide(seen, observations), zero),
        "unique_action_ratio": F.coalesce(unique, zero),
        "consecutive_duplicate_action_count": repeats(normal_actions(steps)),
    }


#: Text views: which fields of a step they show, in order.
_SHOWN = ("action", "observation", "tool_name", "tool_input", "tool_output", "focused_element")
VIEWS = {
    "primary_with_natural_errors": (*_SHOWN, "error"),
    "ablation_without_error_fields": _SHOWN,
    "sensitivity_with_reasoning": (*_SHOWN, "error", "reasoning"),
}


def text_view(instruction: Column, steps: Column, view: str) -> Column:
    """A record as text: tags and values on lines of their own, and a line break at the end.

    A field is shown where it is neither null nor empty, a step where one of its fields is.
    """

    def section(s: Column) -> Column:
        shown = F.array_compact(F.array(*[F.when(s[f] != "", F.concat(F.lit(f"{f.upper()}:\n"), s[f])) for f in VIEWS[view]]))
        head = F.concat(F.lit("[STEP "), s["step_index"].cast("string"), F.lit("]"))
        return let(shown, lambda x: F.when(F.size(x) > 0, F.concat(F.array(head), x)).otherwise(x))

    task = F.array_compact(F.array(F.when(instruction != "", F.concat(F.lit("[TASK]\n"), instruction))))
    return F.concat(F.array_join(F.concat(task, F.flatten(F.transform(steps, section))), "\n"), F.lit("\n"))


def leaks(text: Column, markers: list[Column]) -> Column:
    """Whether a text holds one of the markers, without regard to case."""
    return F.exists(F.array(*markers), lambda m: F.contains(F.lower(text), F.lower(m)))
