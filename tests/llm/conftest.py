import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) pairs, with columns whose names clash with results."""

    def make(rows, extra=""):
        schema = DOC_SCHEMA + extra
        filler = (None,) * extra.count(",")
        full = [(i, t, "en", "s", None if t is None else len(t), *filler) for i, t in rows]
        return spark.createDataFrame(full, schema).repartition(3)

    return make


@pytest.fixture(scope="session")
def sample_texts():
    """Texts with copies, near copies, repeated lines and passages, nulls, blanks and one long text."""
    import random

    draw = random.Random(11)
    vocabulary = [a + b for a in ("th", "an", "re", "on", "ti", "es", "ou", "ha") for b in ("", "er", "ing", "ed", "ly", "é", "9")]

    def prose(sentences):
        said = (" ".join(draw.choice(vocabulary) for _ in range(draw.randint(3, 14))).capitalize() + "." for _ in range(sentences))
        return "".join(s + draw.choice([" ", " ", "\n"]) for s in said).strip()

    base = [prose(draw.randint(4, 25)) for _ in range(30)]
    texts = list(base)
    texts += base[:4] * 3
    for t in base[4:10]:
        w = t.split(" ")
        for _ in range(3):
            v = list(w)
            v[draw.randrange(len(v))] = "changed"
            texts.append(" ".join(v))
    passage = prose(8)
    texts += [prose(3) + " " + passage + " " + prose(3) for _ in range(5)]
    texts += ["Read page 17 of the annual users guide today please\n" + prose(4) for _ in range(4)]
    texts += [f"Posted by user{i} on the first day of may at noon\n" + prose(4) for i in range(5)]
    texts += [None, "", " \n\t ", "one", "one two", "a b c d e f g h i j k l m. " * 40, "x" * 5000, prose(1500)]
    return list(enumerate(texts))
