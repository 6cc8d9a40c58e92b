import random
import re
from collections import defaultdict

from waymark.llm import line_templates as lt


def brute(rows, depth=2, percent=70, min_docs=3):
    """The rule with dictionaries: leaves, weights of tokens at places, templates, documents of templates."""

    def parse(line):
        tokens = re.findall(r"[^\x20\x09-\x0D]+", line)
        digit = [bool(re.search("[0-9]", t)) for t in tokens]
        return tuple(tokens), (len(tokens), tuple("<*>" if d else t for t, d in zip(tokens[:depth], digit))), digit

    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            tokens, _, _ = parse(line)
            if tokens:
                holders[tokens].add(doc_id)
    weight, leaf_docs, leaf_ids = defaultdict(int), defaultdict(int), defaultdict(set)
    for tokens, ids in holders.items():
        _, leaf, digit = parse(" ".join(tokens))
        leaf_docs[leaf] += len(ids)
        leaf_ids[leaf] |= ids
        for i, t in enumerate(tokens):
            if i >= depth and not digit[i]:
                weight[leaf, i, t] += len(ids)

    def template(tokens):
        _, leaf, digit = parse(" ".join(tokens))
        if len(leaf_ids[leaf]) < min_docs:
            return None
        lead = sum(not d for d in digit[:depth])
        needed = max(1, -(-percent * digit.count(False) // 100)) - lead
        found = [(weight[leaf, i, t], i, t) for i, t in enumerate(tokens) if i >= depth and not digit[i] and weight[leaf, i, t] >= min_docs]
        if needed <= 0:
            least = leaf_docs[leaf]
        elif len(found) >= needed:
            least = sorted((w for w, _, _ in found), reverse=True)[needed - 1]
        else:
            return leaf, tokens
        constants = tuple((i, t) for w, i, t in found if w >= least)
        return (leaf, "template", constants) if constants or lead else (leaf, tokens)

    docs_of = defaultdict(set)
    for tokens, ids in holders.items():
        if (t := template(tokens)) is not None:
            docs_of[t] |= ids
    first = {t: min((d for d in ids if d is not None), default=None) for t, ids in docs_of.items() if len(ids) >= min_docs}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        found = [template(parse(x)[0]) if parse(x)[0] else None for x in lines]
        gone = [t in first and first[t] != doc_id for t in found]
        real = [bool(parse(x)[0]) for x in lines]
        cleaned = text if text is None or not any(gone) else "\n".join(x for x, g in zip(lines, gone) if not g)
        out.append((doc_id, cleaned, sum(real), sum(gone)))
    return sorted(out, key=repr)


def run(docs):
    found = lt.without_recurring_lines(docs).collect()
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in found), key=repr)


def test_equals_brute_force(docs_of, sample_texts):
    shared = "The quick brown fox jumps over the lazy dog again"
    rows = sample_texts + [(500, shared), (501, "x y z\n" + shared), (502, shared + "\n\n" + shared), (None, shared), (500, shared), (503, "only 1 line")]
    expected = brute(rows)
    assert run(docs_of(rows, ", n_lines string, template string, drop string, _id string")) == expected
    assert sum(r[3] for r in expected) > 10


def dropped(docs_of, lines):
    return [r.n_dropped for r in lt.without_recurring_lines(docs_of(list(enumerate(lines)))).orderBy("doc_id").collect()]


def test_random_small_vocabulary_equals_brute_force(docs_of):
    draw = random.Random(3)
    word = lambda: draw.choice("aaaabbbccdefgh") if draw.random() < 0.9 else str(draw.randrange(5))
    rows = []
    for i in range(150):
        lines = [" ".join(word() for _ in range(draw.choice((1, 2, 3, 5, 8, 12)))) for _ in range(draw.randint(1, 6))]
        rows.append((i % 140, "\n".join(lines)))
    expected = brute(rows)
    assert run(docs_of(rows)) == expected
    assert 50 < sum(r[3] for r in expected) < sum(r[2] for r in expected)


def test_fields_at_any_places_after_the_path_share_a_template(docs_of):
    assert dropped(docs_of, [f"Posted here by {n} on the first day of the month" for n in ("ann", "bob", "cy", "di")]) == [0, 1, 1, 1]
    assert dropped(docs_of, [f"Order {i * 7} shipped" for i in range(3)]) == [0, 1, 1]
    names = ("anna smith", "bob jones", "carl lee", "dora king")
    assert dropped(docs_of, [f"The server says that {n} signed out at home" for n in names]) == [0, 1, 1, 1]
    assert dropped(docs_of, [f"Posted by {n} in News" for n in ("Ann", "Bob", "Cy")]) == [0, 1, 1]
    assert dropped(docs_of, [f"Go to page {i} of {i + 3}" for i in range(4)]) == [0, 1, 1, 1]


def test_short_lines_recur_and_numbers_alone_do_not(docs_of):
    assert dropped(docs_of, ["Read more"] * 6) == [0, 1, 1, 1, 1, 1]
    assert dropped(docs_of, ["Les."] * 3) == [0, 1, 1]
    assert dropped(docs_of, ["17", "18", "19", "20"]) == [0, 0, 0, 0]


def test_distinct_prose_stays(docs_of):
    lines = ["we all know that red is not blue at noon", "we all know the red was not all at dusk", "we all know why red did not win at home"]
    assert dropped(docs_of, lines) == [0, 0, 0]
    assert dropped(docs_of, ["the cat sat", "the cat ran", "the cat won"]) == [0, 0, 0]


def test_a_template_among_others_of_its_leaf(docs_of):
    lines = [f"we all agree that {n} signed out of the house" for n in ("ann", "bob", "cy")]
    letters = "abcdefghijklmnopqrst"
    lines += [f"we all w{x}{y} x{x}{y} y{x}{y} z{x}{y} out t{x}{y} u{x}{y} v{x}{y}" for x in letters[:2] for y in letters]
    assert dropped(docs_of, lines) == [0, 1, 1] + [0] * 40


def test_two_documents_do_not_recur_and_copies_in_one_document_stay(docs_of):
    rows = [(1, "same line of words here\n" * 5), (2, "same line of words here")]
    assert all(r.n_dropped == 0 for r in lt.without_recurring_lines(docs_of(rows)).collect())


def test_long_tokens_and_empty_table(docs_of):
    rows = [(i, "a" * 200_000 + " b c " + "d" * 1000 + "7") for i in range(3)]
    assert [r.n_dropped for r in lt.without_recurring_lines(docs_of(rows)).orderBy("doc_id").collect()] == [0, 1, 1]
    assert lt.without_recurring_lines(docs_of(rows).limit(0)).collect() == []


def test_main_path_is_native(docs_of):
    plan = lt.without_recurring_lines(docs_of([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
