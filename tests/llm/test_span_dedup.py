import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from waymark.llm import span_dedup as sd


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .!?\n\t\r\"é", max_size=60) | st.text(alphabet="abcdefgh  \n", min_size=100, max_size=400))
def test_sentences_join_to_the_text(text):
    pieces = sd.sentences(text)
    assert "".join(pieces) == text and all(pieces)


def test_long_sentences_are_cut_alike_wherever_they_stand():
    words = [f"w{i * i % 977}" for i in range(200)]
    pieces = sd.sentences(" ".join(words))
    shifted = sd.sentences("other words before " + " ".join(words[7:]) + " and after. End.")
    assert len(pieces) > 8 and "".join(pieces) == " ".join(words)
    assert len(set(pieces[2:-1]) & set(shifted)) >= len(pieces) - 4
    assert sd.sentences("short one. And two.") == ["short one. ", "And two."]


BLANKS = b" \t\n\r\x0b\x0c"


def own_sentences(text):
    """The module's rule in plain Python: sentence ends, and in each the smallest hash of every ten words."""
    raw = text.encode()
    cut, at = [], 0
    while at < len(raw):
        # To the next line break, or to the end of the white space after a full stop.
        to = at
        while to < len(raw):
            if raw[to] == 10:
                to += 1
                break
            if raw[to] in b".!?" and to + 1 < len(raw) and raw[to + 1] in b" \t\r\x0b\x0c":
                to += 1
                while to < len(raw) and raw[to] in b" \t\r\x0b\x0c":
                    to += 1
                break
            to += 1
        words = [(m.start() + at, m[0]) for m in re.finditer(rb"[^ \t\n\r\x0b\x0c]+", raw[at:to])]

        def number(word):
            h = sum((b + 1) ** 3 * 0x9E3779B97F4A7C15 * sd._PLACE_BASE**i for i, b in enumerate(word)) % 2**64
            x = (h ^ h >> 32) * sd._MIXERS[0] % 2**64
            return (x ^ x >> 29) >> 32

        hashes = [number(w) for _, w in words]
        picks = {max(k for k in range(i, i + 10) if hashes[k] == min(hashes[i : i + 10])) for i in range(len(words) - 9)}
        cut += [words[k + 1][0] for k in sorted(picks) if k + 1 < len(words)]
        cut.append(to)
        at = to
    return [raw[x:y].decode() for x, y in zip([0, *cut], cut)]


def brute_spans(text, least=2, words=21):
    pieces = own_sentences(text)
    real = [(i, p.encode().split(None)) for i, p in enumerate(pieces) if p.encode().strip(BLANKS)]
    runs = []
    for a in range(len(real)):
        for b in range(a + least, len(real) + 1):
            if sum(len(w) for _, w in real[a:b]) >= words:
                runs.append((a, b))
                break
    if not runs or runs[-1][1] < len(real):
        for a in range(len(real) - least, -1, -1):
            if sum(len(w) for _, w in real[a:]) >= words:
                runs.append((a, len(real)))
                break
    return [(real[a][0], real[b - 1][0], tuple(x for _, w in real[a:b] for x in w)) for a, b in runs]


def brute(rows):
    first = {}
    for doc_id, text in rows:
        for _, _, body in brute_spans(text or ""):
            first[body] = min(first.get(body, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        pieces, gone, seen = own_sentences(text or ""), set(), set()
        for start, end, body in brute_spans(text or ""):
            if doc_id != first[body] or body in seen:
                gone.update(range(start, end + 1))
            seen.add(body)
        cleaned = "".join(p for i, p in enumerate(pieces) if i not in gone) if gone else text
        out.append((doc_id, cleaned, sum(bool(pieces[i].encode().strip(BLANKS)) for i in gone)))
    return sorted(out)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .!?\n\t\r\"é", max_size=200) | st.text(alphabet="abcdefgh  \n", min_size=100, max_size=400))
def test_sentences_and_spans_follow_the_rule(text):
    assert sd.sentences(text) == own_sentences(text)
    n, first, many, hashes = sd.spans(text, 2, 9)
    expected = brute_spans(text, 2, 9)
    assert list(zip(first.tolist(), (first + many - 1).tolist())) == [(a, b) for a, b, _ in expected]
    assert n == sum(bool(p.encode().strip(BLANKS)) for p in own_sentences(text))
    keys = list(zip(*(h.tolist() for h in hashes)))
    assert all((keys[i] == keys[j]) == (expected[i][2] == expected[j][2]) for i in range(len(keys)) for j in range(i))


def test_equals_brute_force(docs_of, sample_texts):
    passage = " ".join(f"q{i}" for i in range(60)) + "."
    twice = [(900, f"{passage} Between. {passage} End."), (901, f"{passage} {passage}"), (901, f"Other row. {passage}"), (902, passage)]
    rows = sample_texts + twice
    found = sd.without_repeated_spans(docs_of(rows, ", spans string, n_removed string, row string, drop string")).collect()
    expected = brute(rows)
    assert sorted((r.doc_id, r.text, r.n_removed) for r in found) == expected
    assert sum(a[1] != b[1] for a, b in zip(expected, sorted(rows))) > 15


def test_repeated_passage_goes_from_all_but_the_first(docs_of):
    passage = " ".join(" ".join(f"p{i}{j}" for j in range(7)) + "." for i in range(7))
    rows = [(i, f"Own start {i} is here now. {passage} Own end {i} is here too.") for i in (3, 5, 9)]
    found = {r.doc_id: r for r in sd.without_repeated_spans(docs_of(rows)).collect()}
    assert found[3].text == rows[0][1] and found[3].n_removed == 0
    for i in (5, 9):
        assert found[i].text == f"Own start {i} is here now. Own end {i} is here too."


def test_short_repeats_stay(docs_of):
    shared = "This one sentence of ten words stands in many texts. And so does this short one."
    rows = [(i, f"Words of number {i} alone. {shared} More words of number {i}.") for i in range(5)]
    assert sorted((r.doc_id, r.text) for r in sd.without_repeated_spans(docs_of(rows)).collect()) == rows


def test_nulls_repeated_rows_and_empty_tables(docs_of):
    text = " ".join(f"w{i}" for i in range(15)) + ". " + " ".join(f"v{i}" for i in range(15)) + "."
    rows = [(1, text), (1, text), (None, text), (2, None), (2, ""), (4, "short one. and two."), (5, " \n\t ")]
    found = sorted(((r.doc_id, r.text) for r in sd.without_repeated_spans(docs_of(rows)).collect()), key=repr)
    assert found == sorted([(1, text), (1, text), (None, ""), (2, None), (2, ""), (4, "short one. and two."), (5, " \n\t ")], key=repr)
    assert sd.without_repeated_spans(docs_of(rows).limit(0)).collect() == []


def test_rows_without_doc_id_keep_their_own_text(docs_of):
    texts = [f"x{i} " + " ".join(f"y{i * 31 + k}" for k in range(30)) for i in range(400)]
    shared = " ".join(f"s{k}" for k in range(40))
    rows = [(None, t) for t in texts] + [(None, shared + " tail"), (None, "head " + shared)]
    found = sorted(r.text for r in sd.without_repeated_spans(docs_of(rows)).collect())
    assert set(texts) <= set(found) and len(found) == len(rows)
    assert sum("s20" in t.split() for t in found) == 1


def test_very_long_text_and_very_long_word(docs_of):
    body = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, body), (2, "z" * 3_000_000 + " " + body[:1000])]
    found = {r.doc_id: r.text for r in sd.without_repeated_spans(docs_of(rows)).collect()}
    assert found[1] == body and found[2].startswith("z" * 3_000_000) and len(found[2]) < 3_000_200


def test_passages_between_other_words_go_wherever_sentences_end(docs_of):
    draw = random.Random(5)
    rows, passages = [], []
    for n, ends in enumerate([(15, 43), (15, 40), (), (25,), (1, 26), (20, 21, 47), (29,), (8, 17, 26, 35, 44)] * 5):
        words = [f"p{n}x{draw.randrange(10**6)}" for _ in range(58 if n % 2 else 50)]
        passage = " ".join(w + "." if i in ends else w for i, w in enumerate(words))
        passages.append(passage)
        for side in (0, 1):
            own = [" ".join(f"o{n}x{side}x{draw.randrange(10**6)}" for _ in range(draw.randint(1, 40))) for _ in range(2)]
            rows.append((2 * n + side, f"{own[0]} {passage} {own[1]}"))
    found = {r.doc_id: r.text for r in sd.without_repeated_spans(docs_of(rows)).collect()}
    for n, passage in enumerate(passages):
        assert passage in found[2 * n] and passage not in found[2 * n + 1]


LETTERS = st.sampled_from("abcdefghijklmnop")


@settings(max_examples=300, deadline=None)
@given(st.lists(LETTERS, min_size=50, max_size=50), st.lists(st.lists(LETTERS, max_size=25), min_size=4, max_size=4))
def test_fifty_words_hold_a_common_span(passage, around):
    def keys(before, after):
        text = " ".join([*before, "<", *passage, ">", *after])
        return dict(zip(zip(*(h.tolist() for h in sd.spans(text)[3])), (b for *_, b in brute_spans(text))))

    one, two = keys(*around[:2]), keys(*around[2:])
    assert any(b"<" not in one[k] and b">" not in one[k] for k in one.keys() & two.keys())
