"""Substring dedup over sliding spans of sentences.

A text is cut into sentences: after every line break, and after white space
that follows ``.``, ``!`` or ``?``. Within such a sentence the word with the
smallest hash of every ``WINDOW`` successive words (the last of equal ones) ends
one too, so every sentence has at most ``WINDOW`` words, there is one rule for
short and long ones, and the same words are cut alike wherever they stand. The
sentences join to the text again. From every sentence starts a span: the
shortest run of at least ``min_sentences`` sentences that holds at least
``min_words`` words. Where the last of them ends before the text does, one more
span ends with the last sentence. Spans are hashed over their words (96 bits),
so white space does not matter. The first occurrence of a span is the first one
in the document with the smallest doc_id; sentences that any other occurrence
covers are removed.

Cuts are alike in two texts from word ``WINDOW`` of a common passage to as many
words before its end. A passage of ``3 * WINDOW + min_words - 1`` words (47 with
the default values) thus holds a whole span, whatever surrounds it: the first
common cut stands after ``WINDOW`` words at most, and its span ends within
``min_words + WINDOW - 1`` more. Of a longer passage a few words may stay at the
start, and fewer than ``2 * WINDOW`` at the end.

Each text sends every distinct span once, as its hash and the number of its row
only. Spans are counted with map-side partial aggregation and marked by an
equi-join whose skewed partitions adaptive execution splits; a text then gets
the hashes of those of its spans that stand in a smaller doc_id. Rows are met
again by doc_id and 128 bits of a hash of their text.

Edge cases: null texts stay null; texts of fewer than ``min_sentences``
sentences or ``min_words`` words have no span and stay as they are; texts of any
length are cut whole, in memory in proportion to one text; rows that share a
doc_id are one document, so what they share stays in each of them; rows without
doc_id are documents of their own, which come last, in the order of the input's
partitions (equal ones lose the same sentences). A tie between hashes of words
goes to the later word. An empty table gives an empty one. Other columns pass unchanged, whatever their
names; ``n_sentences`` and ``n_removed`` replace input columns of that name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import SPACES, discard, stored

#: In every run of so many words within a sentence at least one ends a piece.
WINDOW = 10
#: Words that a span holds at least.
MIN_WORDS = 21

_ENDS = re.compile(rb"[.!?][ \t\r\x0b\x0c]+|\n")
_BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
#: A word's hash is the sum of its bytes' numbers, each times a power for its place; white space counts nothing.
_BYTES = np.where(_BLANK, 0, np.arange(1, 257, dtype=np.uint64) ** 3 * np.uint64(0x9E3779B97F4A7C15))
_PLACE_BASE = 0xC2B2AE3D27D4EB4F
#: Odd bases of the two hashes of a span, and what mixes the hashes of its words.
_BASES = (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)
_MIXERS = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64: at least ``n`` of them."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        _POWERS[base] = known = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, base, np.uint64)], dtype=np.uint64)
        if size > 1 << 20:
            # What one very long text needs is not kept.
            del _POWERS[base]
    return known


def _mixed(hashes: np.ndarray, by: int) -> np.ndarray:
    x = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(by)
    return x ^ (x >> np.uint64(29))


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(offset, 64-bit hash) of every word."""
    text = np.frombuffer(raw, np.uint8)
    blank = _BLANK[text]
    starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    sizes = np.diff(starts, append=len(text))
    place = np.arange(len(text) - starts[0]) - np.repeat(starts - starts[0], sizes)
    weights = _BYTES[text[starts[0] :]] * _powers(_PLACE_BASE, int(sizes.max()))[place]
    return starts, np.add.reduceat(weights, starts - starts[0], dtype=np.uint64)


def _cuts(starts: np.ndarray, hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Offsets after the last smallest hash of every ``WINDOW`` words that lie between two ``ends``."""
    n = len(starts)
    if n < WINDOW:
        return starts[:0]
    sentence = np.searchsorted(ends, starts, "right")
    windows = np.flatnonzero(sentence[: n - WINDOW + 1] == sentence[WINDOW - 1 :])
    if not len(windows):
        return windows
    # Smallest hash first, then the last word: one number to compare.
    order = ((_mixed(hashes, _MIXERS[0]) >> np.uint64(32)).astype(np.int64) << 31) - np.arange(n)
    least, wide = order, 1
    while wide < WINDOW:
        step = min(wide, WINDOW - wide)
        least, wide = np.minimum(least[:-step], least[step:]), wide + step
    last = np.unique(-least[windows] & 0x7FFFFFFF)
    # The last word of a sentence ends a piece already.
    last = last[last < n - 1]
    return starts[last[sentence[last] == sentence[last + 1]] + 1]


def _cut(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(end of every sentence, offset of every word, its hash) of a text that is not empty."""
    ends = np.array([m.end() for m in _ENDS.finditer(raw)], np.int64)
    if not len(ends) or ends[-1] < len(raw):
        ends = np.append(ends, len(raw))
    starts, hashes = _words(raw)
    return np.union1d(ends, _cuts(starts, hashes, ends)), starts, hashes


def _raw(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def sentences(text: str) -> list[str]:
    """Pieces of a text that join to it: its sentences, cut so that none has more than ``WINDOW`` words."""
    raw = _raw(text)
    ends = _cut(raw)[0].tolist() if raw else []
    return [raw[a:b].decode("utf-8", "surrogatepass") for a, b in pairwise([0, *ends])]


def spans(text: str, min_sentences: int = 2, min_words: int = MIN_WORDS) -> tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(sentences with a word, first sentence and number of sentences of every span, its two hashes)."""
    raw = _raw(text)
    none = np.zeros(0, np.int64)
    if not raw:
        return 0, none, none, [none, none]
    ends, starts, hashes = _cut(raw)
    # Blank sentences count for none; ``before`` has the words before each that is not blank, and all of them.
    counts = np.bincount(np.searchsorted(ends, starts, "right"), minlength=len(ends))
    real = np.flatnonzero(counts)
    before = np.r_[0, np.cumsum(counts[real])]
    n, total = len(real), len(starts)
    stop = np.maximum(np.searchsorted(before, before[:-1] + min_words), np.arange(n) + min_sentences)
    first = np.flatnonzero(stop <= n)
    stop = stop[first]
    if total >= min_words and n >= min_sentences and (not len(stop) or stop[-1] != n):
        # The last span reaches back as far as it must.
        first = np.append(first, min(np.searchsorted(before, total - min_words, "right") - 1, n - min_sentences))
        stop = np.append(stop, n)
    found = []
    for base, by in zip(_BASES, _MIXERS, strict=True):
        sums = np.r_[np.uint64(0), np.cumsum(_mixed(hashes, by) * _powers(base, total)[:total], dtype=np.uint64)]
        inverse = _powers(pow(base, -1, 1 << 64), total + 1)
        found.append(((sums[before[stop]] - sums[before[first]]) * inverse[before[first]]).view(np.int64))
    return n, real[first], real[stop - 1] - real[first] + 1, found


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_wm_k1``, ``_wm_k2``: 128 bits of a hash of the text."""
    return docs.withColumns({"_wm_k1": F.xxhash64("text"), "_wm_k2": F.xxhash64(F.lit(7), "text")})


def _signed(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> 32).astype(np.int32)


_CUT = "doc_id long, k1 long, k2 long, n_sentences long, again boolean, spans array<long>, more array<int>"


def cut_texts(docs: DataFrame, min_sentences: int, min_words: int) -> DataFrame:
    """(doc_id, k1, k2, n_sentences, again, spans, more): a row for each text that is not empty.

    spans, more: 64 and 32 bits of the hash of each distinct span; again: whether one stands twice in the text.
    """
    names = [c.split(" ")[0] for c in _CUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, totals, again, found, more = [], [], [], [], []
            for i, text in enumerate(batch.column(3)):
                if t := text.as_py():
                    n, _, _, (one, two) = spans(t, min_sentences, min_words)
                    distinct, at = np.unique(one, return_index=True)
                    rows.append(i)
                    totals.append(n)
                    again.append(len(distinct) < len(one))
                    found.append(distinct)
                    more.append(_signed(two[at]))
            kept = [batch.column(c).take(pa.array(rows, pa.int64())) for c in range(3)]
            offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            flat = [pa.array(np.concatenate(x) if x else [], k) for x, k in ((found, pa.int64()), (more, pa.int32()))]
            lists = [pa.ListArray.from_arrays(offsets, f) for f in flat]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(totals, pa.int64()), pa.array(again, pa.bool_()), *lists], names)

    slim = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return slim.select("doc_id", "_wm_k1", "_wm_k2", "text").mapInArrow(run, _CUT)


def repeated_spans(docs: DataFrame, min_sentences: int = 2, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, k1, k2, n_sentences, again, spans): the hashes of those spans of each text that an earlier document holds."""
    # Cutting is the costly part, so it is done once; the numbers of the rows are fixed with the table.
    cut = stored(cut_texts(docs, min_sentences, min_words).withColumn("row", F.monotonically_increasing_id()), "cut")
    zipped = F.inline(F.arrays_zip(F.col("spans").alias("span"), F.col("more").alias("rest")))
    # A row without doc_id stands for itself; minima of longs keep the aggregation in hash tables.
    own = F.when(F.col("doc_id").isNull(), F.col("row")).alias("own")
    rows = cut.select("doc_id", own, zipped).toDF("doc_id", "own", "span", "more")
    first = rows.groupBy("span", "more").agg(*[f(c).alias(f"{n}_{c}") for c in ("doc_id", "own") for n, f in (("least", F.min), ("most", F.max))])
    several = "least_doc_id <> most_doc_id OR least_own <> most_own OR (least_doc_id IS NOT NULL AND least_own IS NOT NULL)"
    # As a table of its own both sides of the join are shuffled for it alone, so a hot span's partition can be split.
    firsts = stored(first.where(several).select("span", "more", "least_doc_id", "least_own"), "spans")
    places = cut.select("row", zipped).toDF("row", "span", "more")
    met = places.join(firsts, ["span", "more"]).select("row", "span", "least_doc_id", "least_own")
    known = cut.select("row", "doc_id", "k1", "k2", "n_sentences", "again")
    # The first document of a span: the least doc_id, or the first row where none has one.
    is_first = F.when(F.col("least_doc_id").isNull(), F.col("least_own") == F.col("row")).otherwise(F.col("doc_id").eqNullSafe(F.col("least_doc_id")))
    marks = met.join(known.select("row", "doc_id"), "row").where(~is_first).groupBy("row").agg(F.collect_set("span").alias("spans"))
    whole = known.join(marks, "row", "left")
    # Equal rows without doc_id: what the first of them keeps, all keep.
    found = whole.groupBy("doc_id", "k1", "k2").agg(F.min_by(F.struct("n_sentences", "again", "spans"), "row").alias("m"))
    result = stored(found.select("doc_id", "k1", "k2", "m.*"), "repeated")
    discard(cut)
    discard(firsts)
    return result


def _without(text: str, gone: set[int], min_sentences: int, min_words: int) -> tuple[str, int]:
    """The text without the sentences of spans in ``gone`` and of spans that stand earlier in it, and how many those are."""
    _, first, many, (hashes, _) = spans(text, min_sentences, min_words)
    drop: set[int] = set()
    seen: set[int] = set()
    for start, n, span in zip(first.tolist(), many.tolist(), hashes.tolist(), strict=True):
        if span in gone or span in seen:
            drop.update(range(start, start + n))
        seen.add(span)
    pieces = sentences(text) if drop else []
    kept = "".join(p for i, p in enumerate(pieces) if i not in drop) if drop else text
    return kept, sum(bool(pieces[i].strip(SPACES)) for i in drop)


def _strip(rows: DataFrame, min_sentences: int, min_words: int) -> DataFrame:
    """``rows`` (..., text, _wm_spans, _wm_again, _wm_total) cleaned, with ``n_sentences`` and ``n_removed`` at the end."""
    extra = ("_wm_spans", "_wm_again", "_wm_total")
    kept = [c for c in rows.columns if c not in extra]
    at = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone = [], []
            marked, again, total = (batch.column(len(kept) + k) for k in range(3))
            for text, marks, twice in zip(batch.column(at), marked, again.to_pylist(), strict=True):
                t, found = text.as_py(), marks.as_py()
                cleaned, n = _without(t, set(found or ()), min_sentences, min_words) if found or twice else (t, 0)
                texts.append(cleaned)
                gone.append(n)
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, total, pa.array(gone, pa.int64())], [*kept, "n_sentences", "n_removed"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in kept)
    return rows.select(*[F.col(f"`{c}`") for c in kept], *extra).mapInArrow(run, f"{schema}, n_sentences long, n_removed long")


def without_repeated_spans(docs: DataFrame, min_sentences: int = 2, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with cleaned ``text``, ``n_sentences`` and ``n_removed`` (sentences)."""
    kept = [c for c in docs.columns if c not in ("n_sentences", "n_removed")]
    found = repeated_spans(docs, min_sentences, min_words).toDF("_wm_id", "_wm_a", "_wm_b", "_wm_total", "_wm_again", "_wm_spans")
    left = _keyed(docs.select(*[F.col(f"`{c}`") for c in kept]))
    same = F.col("doc_id").eqNullSafe(F.col("_wm_id")) & (F.col("_wm_k1") == F.col("_wm_a")) & (F.col("_wm_k2") == F.col("_wm_b"))
    joined = left.join(found, same, "left")
    total = F.coalesce("_wm_total", F.lit(0).cast("long")).alias("_wm_total")
    return _strip(joined.select(*[F.col(f"`{c}`") for c in kept], "_wm_spans", "_wm_again", total), min_sentences, min_words)
