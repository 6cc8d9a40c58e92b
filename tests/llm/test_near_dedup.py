import random
import re

import numpy as np
import pytest

from waymark.llm import near_dedup as nd
from waymark.llm.components import connected_components


def sets_of(text, width):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, width, percent):
    sets = [(i, sets_of(t, width)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_components_equal_brute_force(docs_of, sample_texts, width, percent):
    found = nd.similar_components(docs_of(sample_texts, ", component string, bands string"), width, percent).collect()
    expected = brute(sample_texts, width, percent)
    assert sorted(map(tuple, found)) == expected
    assert sum(not r[3] for r in expected) > 15


def test_a_large_group_of_near_copies_in_small_blocks(docs_of):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        copy = list(words)
        for _ in range(draw.randint(0, 6)):
            copy[draw.randrange(len(copy))] = f"x{draw.randrange(10_000)}"
        rows.append((i, " ".join(copy)))
    found = nd.similar_components(docs_of(rows), 3, 85, part_docs=7).collect()
    assert sorted(map(tuple, found)) == brute(rows, 3, 85)


def test_a_chain_of_half_similar_documents_stays_linear(docs_of, monkeypatch):
    words = [f"w{i}" for i in range(3400)]
    chain = [(i, " ".join(words[10 * i : 10 * i + 30])) for i in range(300)]
    chain += [(1000 + i, " ".join([*words[10 * i : 10 * i + 29], "other"])) for i in range(0, 300, 3)]
    met, meet = [], nd._meet

    def counted(pairs, sets, percent):
        met.append(pairs.count())
        return meet(pairs, sets, percent)

    monkeypatch.setattr(nd, "_meet", counted)
    # A wide first banding, so that pairs of similarity 0.5 meet in many buckets.
    monkeypatch.setattr(nd, "banding", lambda percent: (60, 2))
    found = nd.similar_components(docs_of(chain), 3, 85).collect()
    assert sorted(map(tuple, found)) == brute(chain, 3, 85)
    assert sum(not r.kept for r in found) == 100
    assert sum(met) < 60 * len(chain)


def test_buckets_of_much_shared_text_are_narrowed(docs_of):
    draw = random.Random(8)
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [(i, shared + " " + " ".join(f"x{draw.randrange(10**6)}" for _ in range(30))) for i in range(120)]
    rows += [(200 + i, rows[i][1] + " end") for i in range(0, 120, 10)]
    found = nd.similar_components(docs_of(rows), 3, 85, part_docs=20, split=10).collect()
    assert sorted(map(tuple, found)) == brute(rows, 3, 85)
    assert sum(not r.kept for r in found) == 12


def test_recall_at_the_threshold(docs_of):
    draw = random.Random(9)
    rows = []
    for i in range(150):
        words = [f"w{i}x{draw.randrange(10**6)}" for _ in range(draw.choice((9, 42, 62)))]
        # Sets of n shingles that differ in the last ones: similarity (n - k) / (n + k).
        copy = list(words)
        k = max(1, len(words) // 14)
        copy[-k:] = [f"y{j}" for j in range(k)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
    assert sorted(map(tuple, nd.similar_components(docs_of(rows), 3, 85).collect())) == brute(rows, 3, 85)


def test_ids_that_are_null_or_repeated(docs_of):
    text = "one two three four five six seven eight"
    rows = [(None, text), (None, None), (4, text), (4, text), (9, text), (2, None), (3, " ")]
    found = sorted((tuple(r) for r in nd.similar_components(docs_of(rows)).collect()), key=repr)
    assert found == sorted(
        [(None, 4, None, True), (None, 0, None, True), (4, 4, 4, True), (4, 4, 4, True), (9, 4, 4, False), (2, 0, 2, True), (3, 0, 3, True)], key=repr
    )
    assert nd.similar_components(docs_of(rows).limit(0)).collect() == []


def test_signature_estimates_are_unbiased():
    draw = np.random.default_rng(3)
    errors = []
    for share in (0.3, 0.6, 0.9):
        n = 4000
        a = draw.integers(0, 2**63, n, np.uint64)
        b = a.copy()
        fresh = int(n * (1 - share) / (1 + share))
        b[:fresh] = draw.integers(0, 2**63, fresh, np.uint64)
        true = (n - fresh) / (n + fresh)
        m = nd.MinMax(100, 10)
        errors.append(np.mean(m.signature(a) == m.signature(b)) - true)
    assert max(map(abs, errors)) < 0.06


def test_banding_misses_less_than_one_in_a_million():
    for percent in (70, 80, 85, 90, 100):
        bands, rows = nd.banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= 1.01e-6


def test_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    found = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}
