"""Chat formatting with minimum-cost role repair.

A legal chat has at most one system turn, at its start, then user and assistant
turns in alternation, and ends with an assistant turn. Turns of a conversation
(in the order of ``turn``, then role, then text; a null turn comes last) are
repaired by dynamic programming over that automaton: a turn is taken over or
relabelled, joined to the turn before it where both have the same role, and
empty turns are inserted where the automaton asks for one. Each of these has a
cost; the sequence of least total cost is rendered. Among equal costs the one
with fewer rendered turns wins, then the one whose labels come first in the
order system, user, assistant, looking from the last turn to the first.

Conversations are formed by a hash shuffle and a sort and are read as a stream;
a task holds one conversation at a time, whose rendering is one value anyway.

Edge cases: unknown and null roles cost a relabelling; null texts are empty, and
texts of any length pass whole; rows without conv_id are conversations of one
turn each, as nothing tells which of them belong together; repeated rows are
turns of their own (and merge); turns that tie in number, role and text are
equal, so their order does not matter; control marks that stand in a text are
defused by a space; an empty table gives an empty one. Other columns are not
used, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant")
_SYSTEM, _USER, _ASSISTANT, _START = 0, 1, 2, 3
#: Which role may follow which state.
_NEXT = {_START: (_SYSTEM, _USER), _SYSTEM: (_USER,), _USER: (_ASSISTANT,), _ASSISTANT: (_USER,)}


@dataclass(frozen=True)
class Costs:
    merge: int = 1
    relabel: int = 4
    insert: int = 3


def _paths() -> dict[tuple[int, int], tuple[int, ...]]:
    """The shortest run of inserted roles that leads from a state to a role, where there is one."""
    found: dict[tuple[int, int], tuple[int, ...]] = {}
    for state in _NEXT:
        layer = [(state, ())]
        while layer:
            grown = []
            for at, run in layer:
                for role in _NEXT[at]:
                    if (state, role) not in found:
                        found[state, role] = run
                        grown.append((role, (*run, role)))
            layer = grown
    return found


#: A system turn can only be first, so no path leads back to it.
_PATHS = {k: run for k, run in _paths().items() if k[1] != _SYSTEM or k[0] == _START}


def repair(roles: list[str | None], costs: Costs = Costs()) -> tuple[int, list[tuple[int, bool, tuple[int, ...]]], tuple[int, ...]]:
    """(cost, a step for each turn, roles inserted at the end).

    A step is (role, joined to the turn before, roles inserted before it).
    """
    best: dict[int, tuple[int, int]] = {_START: (0, 0)}
    back: list[dict[int, tuple[int, bool]]] = []
    for name in roles:
        reached: dict[int, tuple[int, int]] = {}
        steps: dict[int, tuple[int, bool]] = {}
        for role in range(3):
            label = 0 if name == ROLES[role] else costs.relabel
            for state in range(4):
                if state not in best:
                    continue
                cost, turns = best[state]
                options = []
                if state == role:
                    options.append((cost + label + costs.merge, turns, True))
                if (state, role) in _PATHS:
                    n = len(_PATHS[state, role])
                    options.append((cost + label + n * costs.insert, turns + n + 1, False))
                for total, shown, joined in options:
                    if role not in reached or (total, shown) < reached[role]:
                        reached[role] = (total, shown)
                        steps[role] = (state, joined)
        best = reached
        back.append(steps)
    tails = {_ASSISTANT: (), _USER: (_ASSISTANT,), _SYSTEM: (_USER, _ASSISTANT)}
    ends = [(c + len(tails[s]) * costs.insert, t + len(tails[s]), s) for s, (c, t) in best.items() if s != _START]
    if not ends:
        return 0, [], ()
    cost, _, state = min(ends)
    tail = tails[state]
    out: list[tuple[int, bool, tuple[int, ...]]] = []
    for steps in reversed(back):
        before, joined = steps[state]
        out.append((state, joined, () if joined else _PATHS[before, state]))
        state = before
    return cost, out[::-1], tail


def render(turns: list[tuple[str, str]]) -> str:
    """Turns between control marks; marks inside a text are defused."""
    return "".join(f"<|im_start|>{role}\n{text.replace('<|', '< |')}<|im_end|>\n" for role, text in turns)


def repaired(roles: list[str | None], texts: list[str | None], costs: Costs = Costs()) -> tuple[int, str, list[tuple[str, str]]]:
    """(cost, edits, turns) of one conversation; edits: k(ept), r(elabelled), j(oined), i(nserted) in order."""
    cost, steps, tail = repair(roles, costs)
    turns: list[tuple[str, list[str]]] = []
    edits = []
    for name, text, (role, joined, inserted) in zip(roles, texts, steps, strict=True):
        turns += [(ROLES[r], [""]) for r in inserted]
        edits += ["i"] * len(inserted)
        edits.append(("k" if name == ROLES[role] else "r") + "j" * joined)
        if joined:
            turns[-1][1].append(text or "")
        else:
            turns.append((ROLES[role], [text or ""]))
    turns += [(ROLES[r], [""]) for r in tail]
    edits += ["i"] * len(tail)
    return cost, " ".join(edits), [(role, "\n\n".join(parts)) for role, parts in turns]


_SCHEMA = "conv_id long, n_turns long, n_rendered long, cost long, edits string, rendered string"


def formatted(conversations: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """(conv_id, n_turns, n_rendered, cost, edits, rendered) for (conv_id, turn, role, text)."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    names = [c.split(" ")[0] for c in _SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        key, roles, texts = None, [], []

        def close() -> None:
            if roles:
                cost, edits, turns = repaired(roles, texts, costs)
                done.append((key, len(roles), len(turns), cost, edits, render(turns)))

        def flush() -> pa.RecordBatch:
            arrays = [pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)]
            done.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(3)]
            for conv_id, role, text in zip(*columns, strict=True):
                if conv_id != key or conv_id is None:
                    close()
                    key, roles, texts = conv_id, [], []
                    if len(done) >= 256:
                        yield flush()
                roles.append(role)
                texts.append(text)
        close()
        yield flush()

    slim = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    # Rows without conv_id stand alone: deal them out by their content.
    spread = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text")).otherwise(F.lit(0))
    order = ["conv_id", F.col("turn").asc_nulls_last(), F.col("role"), F.col("text")]
    sorted_rows = slim.repartition("conv_id", spread).sortWithinPartitions(*order)
    return sorted_rows.select("conv_id", "role", "text").mapInArrow(run, _SCHEMA)
