import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from waymark.llm import bpe

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def own():
    return bpe.WordTokenizer(PATH)


def check(own, texts):
    for text, ids in zip(texts, own.encode(texts), strict=True):
        expected = own.library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == expected, text
        assert bpe.decoder(PATH).decode(ids) == own.library.decode(expected, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4))
def test_any_text_equals_the_library(texts):
    check(bpe.tokenizer(PATH), texts)


def test_words_that_need_exact_merging(own, sample_texts):
    draw = random.Random(2)
    words = ["".join(draw.choice("abcdehinorstu") for _ in range(draw.randint(1, 14))) for _ in range(3000)]
    before = own.merged_exactly
    check(own, [" ".join(words), *[t or "" for _, t in sample_texts]])
    assert own.merged_exactly > before


def test_speculation_is_exact_per_word(own):
    draw = random.Random(4)
    words = ["".join(draw.choice("aehnrst") for _ in range(draw.randint(1, 12))) for _ in range(2000)]
    found, exact = own.merges.encode(words)
    assert found == [own.merges.exact(w) for w in words]
    assert 0 < exact < len(words)


def test_special_tokens_long_words_and_odd_blanks(own):
    check(own, ["", "a<|endoftext|>b <|startoftext|>", "<|endoftext|", "a" * 4000, "ab" * 900 + "!" * 700, "a\x1cb\x85c\u2003d\xa0e", "İıΣς é e\u0301 你好 \U0001d11e"])


def test_frame_round_trip(docs_of, own):
    rows = [(1, "Hello, World's end"), (2, None), (None, ""), (1, "Hello, World's end"), (3, "x" * 5000)]
    found = bpe.decoded(bpe.encoded(docs_of(rows, ", ids string, decoded string").drop("decoded"), PATH), PATH)
    assert found.columns == ["doc_id", "lang", "source", "n_chars", "ids", "decoded"]
    expected = {t or "": own.library.decode(own.library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for _, t in rows}
    assert sorted(r.decoded for r in found.collect()) == sorted(expected[t or ""] for _, t in rows)
    assert bpe.encoded(docs_of(rows).limit(0), PATH).collect() == []


def test_round_trip_digests(docs_of, own, sample_texts):
    import hashlib

    found = bpe.round_trips(docs_of(sample_texts), PATH).collect()
    texts = dict(sample_texts)
    for r in found:
        ids = own.library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        text = own.library.decode(ids, skip_special_tokens=False)
        raw = np.array(ids, "<u4").tobytes()
        expected = (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected
    assert len(found) == len(texts)
