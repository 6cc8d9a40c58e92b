import random
import re

from waymark.llm import quality_rules as qr


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    inside = {j for at in windows.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(inside),
    )


def test_statistics_equal_brute_force(docs_of, sample_texts):
    odd = [(900, "a a a a a"), (901, "# * $%&|<>\n#\n#"), (902, "a\x0bb\x0cc\rd a b c d"), (903, "é𝄞  x"), (None, "no id here"), (900, "a a a")]
    rows = sample_texts + odd
    found = qr.with_statistics(docs_of(rows, ", n_words string, kept string")).collect()
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found)
    assert got == sorted((-1 if i is None else i, *brute(t)) for i, t in rows)


def test_base_rules(docs_of):
    texts = [(1, "w " * 49), (2, " ".join(f"w{i}" for i in range(50))), (3, "a b c " * 20), (4, None)]
    found = {r.doc_id: r.base_failed for r in qr.judged(docs_of(texts), qr.DecisionList()).collect()}
    assert found == {1: True, 2: False, 3: True, 4: True}


def test_learned_list_is_ordered_and_precise():
    rows = [((float(i % 100), float(i % 7)), i % 100 > 90) for i in range(1000)]
    rows += [((5.0, 30.0 + i), True) for i in range(40)]
    rules = qr.learn(rows, names=("words", "mean_word_chars"))
    assert 1 <= len(rules.rules) <= 4 and all(r.precision >= 0.95 for r in rules.rules)

    def rejected(v):
        at = dict(zip(("words", "mean_word_chars"), v, strict=True))
        return any(all((at[c.feature] > c.threshold) == c.above for c in r.conditions) for r in rules.rules)

    assert sum(rejected(v) != bad for v, bad in rows) == 0


def test_conjunctions_are_grown():
    draw = random.Random(1)
    names = ("words", "mean_word_chars", "digit_share")

    def row():
        x, y = draw.random(), draw.random()
        return (x, y, draw.random()), x > 0.6 and y > 0.6

    rules = qr.learn([row() for _ in range(6000)], names)
    assert rules.rules and {c.feature for c in rules.rules[0].conditions} == {"words", "mean_word_chars"}
    assert all(c.above and abs(c.threshold - 0.6) < 0.03 for c in rules.rules[0].conditions)
    rejected, right, n, bad = qr.measured(rules, [row() for _ in range(4000)], names).held_out
    assert n == 4000 and right / rejected > 0.98 and right / bad > 0.9


def test_several_rules_cover_several_kinds():
    draw = random.Random(6)

    def row():
        x, y = draw.random(), draw.random()
        return (x, y), x > 0.9 or (x < 0.2 and y < 0.3)

    names = ("words", "mean_word_chars")
    rules = qr.learn([row() for _ in range(6000)], names)
    assert len(rules.rules) >= 2 and max(len(r.conditions) for r in rules.rules) == 2
    rejected, right, _, bad = qr.measured(rules, [row() for _ in range(4000)], names).held_out
    assert right / rejected > 0.98 and right / bad > 0.8


def test_pruning_drops_what_only_fits_the_growing_rows():
    # Sorted by the first value, every third row prunes; the second value is noise that fits the growing rows alone.
    rows = [((float(i), float(i % 3 > 0 and i >= 300)), i >= 300) for i in range(600)]
    work = qr.Covering(rows, ("words", "mean_word_chars"), 48)
    by_noise = next(c for c in work.table if c[0].feature == "mean_word_chars" and c[0].above)
    by_words = max((c for c in work.table if c[0].feature == "words" and c[0].above), key=lambda c: work.gain(work.all, c[1]))
    assert work.pruned([by_words, by_noise], work.all) == [by_words]
    assert work.pruned([by_noise], work.all) == [by_noise]


def features_of(text):
    words, chars, symbols, dup, repeat = brute(text)
    text = text or ""
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, total = max(words, 1), max(len(text), 1)
    upper, digits = len(re.findall("[A-Z]", text)), len(re.findall("[0-9]", text))
    return words, chars / n, symbols / n, repeat / n, dup / max(len(lines), 1), upper / total, digits / total


def test_verdicts_equal_brute_force(docs_of, sample_texts):
    rules = qr.DecisionList(
        (
            qr.Rule((qr.Condition("repeat_share", True, 0.2), qr.Condition("words", True, 200.0)), 1.0, 9),
            qr.Rule((qr.Condition("upper_share", False, 0.025),), 1.0, 9),
            qr.Rule((qr.Condition("mean_word_chars", True, 3.0), qr.Condition("digit_share", True, 0.02), qr.Condition("dup_line_share", False, 0.5)), 1.0, 9),
        )
    )
    found = qr.judged(docs_of(sample_texts, ", kept string, rule string, base_failed string"), rules).collect()
    texts, fired = dict(sample_texts), set()
    for r in found:
        values = features_of(texts[r.doc_id])
        words, _, _, _, repeat = brute(texts[r.doc_id])
        at = dict(zip(qr.FEATURES, values, strict=True))
        fits = [all((at[c.feature] > c.threshold) == c.above for c in rule.conditions) for rule in rules.rules]
        assert r.rule == (fits.index(True) + 1 if any(fits) else None)
        assert r.base_failed == (words < 50 or 100 * repeat > 50 * words)
        assert r.kept == (not r.base_failed and not any(fits))
        fired.add(r.rule)
    assert fired == {None, 1, 2, 3}, fired


def test_repeated_doc_ids_teach_once(spark, docs_of):
    docs = docs_of([(i % 7, f"w{i} " + " ".join(f"w{i * j % 97}" for j in range(70))) for i in range(300)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)], "doc_id long, quality int")
    assert qr.learn_from_labels(docs, labels).held_out[2] <= 7


def test_learning_without_examples():
    assert qr.learn([]).rules == ()
    assert qr.learn([((1.0,) * 7, False)] * 20).rules == ()


def test_labels_and_empty_tables(spark, docs_of):
    clean = [(i, " ".join(f"w{i * j % 997}" for j in range(60))) for i in range(1, 121)]
    junk = [(1000 + i, " ".join(f"w{i * j % 991}#$%" for j in range(60))) for i in range(60)]
    docs = docs_of(clean + junk)
    labels = spark.createDataFrame([(i, 1) for i, _ in clean] + [(i, 0) for i, _ in junk] + [(3, 0), (None, 1), (5, None)], "doc_id long, quality int")
    rules = qr.learn_from_labels(docs, labels)
    kept = {r.doc_id for r in qr.judged(docs, rules).where("kept").collect()}
    assert kept == {i for i, _ in clean}
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert qr.learn_from_labels(docs, empty).rules == ()
    assert qr.judged(docs.limit(0), rules).collect() == []


def test_main_path_is_native(docs_of):
    plan = qr.judged(docs_of([(1, "a")]), qr.DecisionList())._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
