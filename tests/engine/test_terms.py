import math
import random
import re
from collections import Counter, defaultdict

import pytest

from waymark.operators import ml, terms


def brute_force(docs, longest, min_df, max_df, size):
    counts = defaultdict(Counter)
    for key, text in docs:
        words = re.findall(r"\b\w\w+\b", (text or "").lower())
        counts[key].update(" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1))
    df, total = Counter(t for c in counts.values() for t in c), sum(counts.values(), Counter())
    known = sorted((t for t in df if min_df <= df[t] <= max_df * len(docs)), key=lambda t: (-total[t], t))[:size]
    out = {}
    for key, c in counts.items():
        raw = {t: (1 + math.log(c[t])) * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t in known if t in c}
        out |= {(key, t): w / math.sqrt(sum(v * v for v in raw.values())) for t, w in raw.items()}
    return out


def same(found, expected):
    assert found.keys() == expected.keys() and all(found[k] == pytest.approx(expected[k], abs=1e-12) for k in found)


def test_terms_match_brute_force_with_null_and_repeated_keys(spark):
    draw = random.Random(5)
    text = lambda: " ".join(draw.choices([f"w{i}" for i in range(12)], [2**-i for i in range(12)], k=draw.randrange(1, 30)))
    docs = [(i, text()) for i in range(20)] + [(None, text()), (None, text()), (3, text()), (3, text()), (20, None), (21, "")]
    df = spark.createDataFrame(docs, "id int, text string").repartition(3)
    variants = {"T1": 1, "T2": 2, "T3": 3}
    for max_df, size in ((1.0, 20_000), (1.0, 9), (0.5, 9)):
        found = ml.tfidf_variants(df, "id", "text", variants, max_df=max_df, max_features=size).collect()
        for name, longest in variants.items():
            same({(r.id, r.term): r.weight for r in found if r.variant == name}, brute_force(docs, longest, 2, max_df, size))


def test_vocabulary_is_counted_again_when_the_limit_was_too_high(spark, monkeypatch):
    docs = [(i, "aa bb cc dd ee ff " * 3 + f"gg{i % 3} hh{i % 4}") for i in range(12)]
    rounds, count = [], terms.frequencies
    monkeypatch.setattr(terms, "frequencies", lambda d, s: rounds.append(s) or count(d, s))
    found = ml.tfidf(spark.createDataFrame(docs, "id int, text string"), "id", "text", max_df=0.9, max_features=3)
    same({(r.id, r.term): r.weight for r in found.collect()}, brute_force(docs, 1, 2, 0.9, 3))
    assert len(rounds) == 2


def test_weights_shuffle_nothing(spark):
    docs = spark.createDataFrame([(1, "aa bb"), (2, "aa cc"), (3, "bb cc")], "id int, text string")
    found = ml.tfidf(docs, "id", "text", 2)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 6


def test_no_documents(spark):
    assert ml.tfidf(spark.createDataFrame([], "id int, text string"), "id", "text", 2).collect() == []
