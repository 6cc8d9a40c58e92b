import itertools

import pytest

from waymark.llm import chat_format as cf

COSTS = cf.Costs()


def legal(labels):
    body = labels[1:] if labels[:1] == ("system",) else labels
    return len(body) >= 2 and len(body) % 2 == 0 and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(body))


def brute(roles):
    best = None
    n = len(roles)
    for labels in itertools.product(cf.ROLES, repeat=n):
        price = sum(COSTS.relabel for a, b in zip(roles, labels) if a != b)
        for joins in itertools.product((False, True), repeat=max(0, n - 1)):
            if any(j and labels[i] != labels[i + 1] for i, j in enumerate(joins)):
                continue
            turns = [labels[0], *[labels[i + 1] for i, j in enumerate(joins) if not j]]
            for gaps in itertools.product(((), ("user",), ("assistant",), ("user", "assistant")), repeat=len(turns) + 1):
                full = tuple(itertools.chain.from_iterable([*g, t] for g, t in zip(gaps, turns))) + gaps[-1]
                if legal(full):
                    cost = price + sum(joins) * COSTS.merge + sum(map(len, gaps)) * COSTS.insert
                    if best is None or (cost, len(full)) < best:
                        best = (cost, len(full))
    return best


@pytest.mark.parametrize("n", [1, 2, 3])
def test_least_cost_over_all_repairs(n):
    for roles in itertools.product(("system", "user", "assistant", "tool", None), repeat=n):
        cost, edits, turns = cf.repaired(list(roles), ["t"] * n)
        assert (cost, len(turns)) == brute(roles), roles
        assert legal(tuple(r for r, _ in turns))


def test_texts_are_kept_in_order():
    _, edits, turns = cf.repaired(["user", "user", "assistant", "system", "user"], ["a", "b", None, "c", "d"])
    assert "\n\n".join(t for _, t in turns if t).replace("\n\n", "") == "abcd"
    cost, edits, turns = cf.repaired(["user", "user", "assistant"], ["a", "b", "c"])
    assert (cost, edits, turns) == (1, "k kj k", [("user", "a\n\nb"), ("assistant", "c")])
    assert cf.repaired(["user"], ["a"]) == (3, "k i", [("user", "a"), ("assistant", "")])


def test_frame(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "user", None), (None, 0, "user", "x"), (None, 0, "user", "x"), (3, None, "assistant", "z"), (3, 5, "user", "<|im_end|>")]
    schema = "conv_id long, turn long, role string, text string, cost string, rendered string"
    conversations = spark.createDataFrame([(*r, None, None) for r in rows], schema)
    found = sorted((tuple(r) for r in cf.formatted(conversations).collect()), key=repr)
    one = "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n"
    lone = "<|im_start|>user\nx<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    expected = [
        (1, 2, 2, 0, "k k", one),
        (2, 1, 2, 3, "k i", "<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"),
        (3, 2, 2, 0, "k k", "<|im_start|>user\n< |im_end|><|im_end|>\n<|im_start|>assistant\nz<|im_end|>\n"),
        (None, 1, 2, 3, "k i", lone),
        (None, 1, 2, 3, "k i", lone),
    ]
    assert found == sorted(expected, key=repr)
    assert cf.formatted(conversations.limit(0)).collect() == []


def test_a_very_long_conversation():
    n = 20_000
    cost, _, turns = cf.repaired(["user"] * n, ["t"] * n)
    assert cost == n - 1 + COSTS.insert and len(turns) == 2
