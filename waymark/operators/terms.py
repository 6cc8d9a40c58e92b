"""Terms of texts: their frequencies in a corpus, its vocabulary and their weights by document, without a shuffle of (document, term) pairs.

A document is counted where it is read, in runs of about 2^19 words. What is shuffled are sums: totals of hash slots first,
then counts of those terms whose slot is full enough for the vocabulary, and nothing for the weights. The slots only rule
terms out, as a slot's total is not less than that of any term in it; the vocabulary comes from exact counts.

Edge cases: a null, empty or wordless text has no terms but counts as a document; rows of one key are one document, and
terms do not run from one of its texts into the next; ties at the end of the vocabulary go by name; a text of any length
is counted at once, so the words of one document must fit in a task. The vocabulary and the slots pass through the driver.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORD = re.compile(r"\w\w+")
#: Words that are counted together.
_RUN = 1 << 19
#: Hash slots for each number of words in a term.
_SLOT_BITS = 20
#: Slots looked at first, as a multiple of the vocabulary's size: some are full without a frequent term.
_SPARE = 2
_MIX, _LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def plain(text: str) -> str:
    """Decomposed, without combining marks."""
    if text.isascii():
        return text
    return "".join([c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)])


class Run:
    """The words of some documents, one after the other, as codes of distinct words."""

    def __init__(self, words: list[str], rows: list[int], sizes: list[int]):
        """``rows`` and ``sizes``: row and number of words of each text."""
        coded = pa.array(words, pa.string()).dictionary_encode()
        self.row, self.part = np.repeat(np.asarray(rows, np.int64), sizes), np.repeat(np.arange(len(sizes)), sizes)
        self.codes, self.names = coded.indices.to_numpy().astype(np.int64), coded.dictionary

    def terms(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(n, does the term of n words from here lie in one text, its slot, its code in this run) by number of words."""
        crc = np.array([zlib.crc32(w.encode()) for w in self.names.to_pylist()], np.uint64)[self.codes]
        mixed, code = crc, self.codes
        for n in range(1, min(longest, len(self.codes)) + 1):
            if n > 2:  # small enough for a product again
                code = np.unique(code, return_inverse=True)[1]
            if n > 1:
                mixed, code = mixed[:-1] * _MIX + crc[n - 1 :], code[:-1] * len(self.names) + self.codes[n - 1 :]
            within = self.part[: len(self.part) - n + 1] == self.part[n - 1 :]
            slot = (mixed ^ (mixed >> np.uint64(29))) * _LAST >> np.uint64(64 - _SLOT_BITS)
            yield n, within, slot.astype(np.int64), code

    def counted(self, open_slots: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """(row, place of the term, times) of every term of a row whose slot is open; (words, text) of the terms."""
        found, sizes, texts, base = [], [], [], 0
        for n, within, slot, code in self.terms(len(open_slots)):
            at = np.flatnonzero(within & open_slots[n - 1][slot])
            _, first, term = np.unique(code[at], return_index=True, return_inverse=True)
            pairs, times = np.unique(self.row[at] * max(len(first), 1) + term, return_counts=True)
            row, term = np.divmod(pairs, max(len(first), 1))
            found.append((row, term + base, times))
            words = [self.names.take(pa.array(self.codes[at[first] + i])) for i in range(n)]
            texts.append(pc.binary_join_element_wise(*words, " "))
            sizes.append(np.full(len(first), n))
            base += len(first)
        return *(np.concatenate(x) for x in zip(*found, strict=True)), np.concatenate(sizes), pa.concat_arrays(texts)


def runs(batch: pa.RecordBatch) -> Iterator[Run]:
    """Whole rows of (key, lower-cased texts)."""
    words, rows, sizes = [], [], []
    for row, texts in enumerate(batch.column(1)):
        for text in texts.as_py():
            found = _WORD.findall(plain(text).lower()) if text else []
            words += found
            rows.append(row)
            sizes.append(len(found))
        if len(words) >= _RUN:
            yield Run(words, rows, sizes)
            words, rows, sizes = [], [], []
    if words:
        yield Run(words, rows, sizes)


def slots_of(terms: Iterable[str], longest: int) -> list[np.ndarray]:
    """Which slots hold given terms, by number of words."""
    split = [t.split(" ") for t in terms]
    out = [np.zeros(1 << _SLOT_BITS, bool) for _ in range(longest)]
    for n in range(1, longest + 1):
        if same := [t for t in split if len(t) == n]:
            run = Run([w for t in same for w in t], list(range(len(same))), [n] * len(same))
            *_, (_, within, slot, _) = run.terms(n)
            out[n - 1][slot[within]] = True
    return out


def slot_totals(docs: DataFrame, longest: int) -> np.ndarray:
    """(words, slot): how many terms the documents have in each slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((longest, 1 << _SLOT_BITS), np.int64)
        for words in (r for b in batches for r in runs(b)):
            for n, within, slot, _ in words.terms(longest):
                totals[n - 1] += np.bincount(slot[within], minlength=1 << _SLOT_BITS)
        n, slot = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(totals[n, slot])], ["n", "slot", "total"])

    found = docs.mapInArrow(run, "n int, slot int, total long").groupBy("n", "slot").agg(F.sum("total").alias("total")).toArrow()
    out = np.zeros((longest, 1 << _SLOT_BITS), np.int64)
    out[found["n"].to_numpy(), found["slot"].to_numpy()] = found["total"].to_numpy()
    return out


def frequencies(docs: DataFrame, open_slots: list[np.ndarray]) -> DataFrame:
    """(term, words, df, total) of every term in an open slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in (r for b in batches for r in runs(b)):
            _, term, times, sizes, texts = words.counted(open_slots)
            df, total = np.bincount(term, minlength=len(texts)), np.bincount(term, times, len(texts)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([texts, pa.array(sizes.astype(np.int32)), pa.array(df), pa.array(total)], ["term", "words", "df", "total"])

    found = docs.mapInArrow(run, "term string, words int, df long, total long")
    return found.groupBy("term").agg(F.max("words").alias("words"), F.sum("df").alias("df"), F.sum("total").alias("total"))


#: (term, words, df, total)
Term = tuple[str, int, int, int]


def vocabularies(docs: DataFrame, longests: set[int], min_df: int, most_df: float, size: int) -> dict[int, list[Term]]:
    """By longest term: the ``size`` terms with the highest totals, then by name, of those of at least ``min_df`` and at most ``most_df`` documents.

    Terms are counted whose slots reach a limit. If each vocabulary is full and its last term reaches the limit, no term
    outside can belong to it. Otherwise that last term is a limit that none of the vocabulary falls short of, and the
    terms are counted once more.
    """
    longest = max(longests)
    totals = slot_totals(docs, longest)
    limit = min(int(np.partition(totals[:k].ravel(), -_SPARE * size)[-_SPARE * size]) if totals[:k].size >= _SPARE * size else 0 for k in longests)
    least = max(min_df, 1)  # a term's total is not less than its documents
    limit = max(limit, least)
    while True:
        counts = frequencies(docs, list(totals >= limit)).where((F.col("df") >= min_df) & (F.col("df") <= most_df))
        tops = [counts.where(F.col("words") == n).orderBy(F.desc("total"), "term").limit(size) for n in range(1, longest + 1)]
        found = [tuple(r.values()) for r in reduce(DataFrame.union, tops).toArrow().to_pylist()]
        found.sort(key=lambda t: (-t[3], t[0]))
        out = {k: [t for t in found if t[1] <= k][:size] for k in longests}
        proven = min((terms[-1][3] if len(terms) == size else least) for terms in out.values()) if size else limit
        if proven >= limit:
            return out
        limit = proven


def gathered(rows: DataFrame) -> DataFrame:
    """(key, texts) of rows (key, text); grouped only if a key repeats."""
    key, text = rows.columns
    if rows.groupBy(key).count().where("count > 1").isEmpty():
        return rows.select(key, F.array(text).alias("_texts"))
    return rows.groupBy(key).agg(F.collect_list(text).alias("_texts"))


def weights(docs: DataFrame, vocabulary: dict[str, dict[str, float]], longest: int) -> DataFrame:
    """(key, term, weight, variant): (1 + ln tf) * idf by the variant's vocabulary, scaled to length one by document and variant."""
    terms = sorted({t for idf in vocabulary.values() for t in idf})
    known, tables = pa.array(terms, pa.string()), {name: np.array([idf.get(t, 0.0) for t in terms]) for name, idf in vocabulary.items()}
    open_slots = slots_of(terms, longest)
    schema = T.StructType([docs.schema[0], T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType()), T.StructField("variant", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in runs(batch):
                row, term, times, _, texts = words.counted(open_slots)
                place = pc.fill_null(pc.index_in(texts, value_set=known), -1).to_numpy()[term]
                in_any = place >= 0
                row, place, rise = row[in_any], place[in_any], 1 + np.log(times[in_any])
                for name, idf in tables.items():
                    kept = idf[place] != 0
                    at, w = row[kept], rise[kept] * idf[place[kept]]
                    w /= np.sqrt(np.bincount(at, w * w))[at]
                    columns = [batch.column(0).take(pa.array(at)), known.take(pa.array(place[kept])), pa.array(w), pa.repeat(pa.scalar(name), len(w))]
                    yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.mapInArrow(run, schema)
