"""Byte-pair encoding and decoding by speculation and verification.

A word is first cut greedily into the longest tokens of the vocabulary (all new
words of a batch in one pass of an Aho-Corasick automaton). That proposal equals
the result of merging by rank exactly if every token is what its own characters
merge to and no merge ever crosses the boundary of two neighbours, and the
second condition needs pairs of neighbours only. All pairs of all proposals of a
batch are tested together with array operations. Words with a failing token or
pair are merged exactly: together, a merge of every such word at a time, and
those of over ``_TOGETHER`` start symbols one by one, with a heap of ranks.

The vocabulary file is read where the work is done (its path is a parameter).
Normalisation is that of the file's own normalizer. Pieces between white space
are independent of each other, so their ids are remembered by piece.

Edge cases: null and empty texts have no ids; special tokens that stand in a text
become their ids; a text of any length is encoded whole, and a word of any length
costs n log n; of merges of equal rank the leftmost comes first; repeated rows
get equal results; an empty table gives an empty one. Other columns pass
unchanged; ``ids`` and ``decoded`` replace input columns of that name.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_END = "</w>"
#: What counts as white space for the vocabulary's pattern.
_BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The pattern of the vocabulary file; every match is a word.
_WORD = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_BLANK}\p{{L}}\p{{N}}]+"
#: Pieces and words that a worker remembers, and the longest that it does.
_REMEMBERED, _LONGEST = 250_000, 48
#: Words of up to so many start symbols are merged together.
_TOGETHER = 64
#: Added to a letter that ends a word, so that tokens with the end mark fit there only.
_LAST = 0x1000
_ROWS = 512
#: Ids that are decoded at once: bounds the memory that a long text needs.
_GATHERED = 1 << 16


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class Merges:
    """Ranked merges over token ids, with the exact and the speculative encoding of words.

    ``words`` are sequences of start symbols, given as strings of the vocabulary.
    Ids of merged tokens must grow with the rank of their merge, and each token
    must have one merge; both are checked.
    """

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], end: str = _END) -> None:
        self.vocab, self.end = vocab, end
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        size = max(vocab.values()) + 1
        self.size = size
        made = np.array([m for _, _, m in pairs], np.int64)
        if np.any(np.diff(made) <= 0):
            raise ValueError("ids must grow with the rank of the merge")
        self.left = np.full(size, -1, np.int64)
        self.right = np.full(size, -1, np.int64)
        self.left[made] = [a for a, _, _ in pairs]
        self.right[made] = [b for _, b, _ in pairs]
        if not set(np.flatnonzero(self.left < 0)[np.flatnonzero(self.left < 0) > made[0]].tolist()).isdisjoint(vocab.values()):
            raise ValueError("a start symbol has a higher id than a merged token")
        keys = np.array([a * size + b for a, b, _ in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.made = keys[order], made[order]
        self.join = {(a, b): m for a, b, m in pairs}
        self.sound = np.ones(size, bool)
        self.sound[made] = self._apart(self.left[made], self.right[made], made)
        for m in made.tolist():  # ids grow with rank, so the parts are settled before the whole
            self.sound[m] &= self.sound[self.left[m]] and self.sound[self.right[m]]
        self.inner = {t: i for t, i in vocab.items() if not t.endswith(end)}
        self.final = {t[: -len(end)]: i for t, i in vocab.items() if t.endswith(end) and t != end}
        self.reach = max([len(t) for t in (*self.inner, *self.final)])
        #: Ids of one-letter tokens by code point, without and with the end mark.
        self.inner_ids, self.final_ids = np.full(0x400, -1, np.int64), np.full(0x400, -1, np.int64)
        for table, known in ((self.inner_ids, self.inner), (self.final_ids, self.final)):
            for token, i in known.items():
                if len(token) == 1:
                    table[ord(token)] = i
        self.ends = np.zeros(size, bool)
        self.ends[list(self.final.values())] = True
        self._finder = None

    def finder(self):
        """The automaton over all tokens; the last letter of a final one is moved by ``_LAST``."""
        if self._finder is None:
            import ahocorasick

            self._finder = ahocorasick.Automaton()
            for token, i in self.inner.items():
                self._finder.add_word(token, i)
            for token, i in self.final.items():
                self._finder.add_word(token[:-1] + chr(ord(token[-1]) + _LAST), i)
            self._finder.make_automaton()
        return self._finder

    def _merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id that each pair merges to; the size of the vocabulary where it does not."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], self.size)

    def _apart(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Whether neighbours a, b stay apart in merges of a rank under ``limit``.

        Undoes the merges along the boundary from the latest to the first. At
        each point the two parts that touch would merge if that merge came
        before the merges that use up either part; between equal ranks the one
        further left comes first.
        """
        a, b, limit = a.copy(), b.copy(), limit.copy()
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            crossing = self._merged(x, y) < limit[live]
            good[live[crossing]] = False
            whole = (self.left[x] < 0) & (self.left[y] < 0)
            go = live[~crossing & ~whole]
            x, y = a[go], b[go]
            undo_left = x > y
            limit[go] = np.where(undo_left, x, y + 1)
            a[go] = np.where(undo_left, self.right[x], x)
            b[go] = np.where(undo_left, y, self.left[y])
            live = go
        return good

    def propose(self, word: str) -> list[int]:
        """Greedy longest matches; the word's last token carries the end mark."""
        found, at, n = [], 0, len(word)
        inner, final, reach = self.inner, self.final, self.reach
        while at < n:
            if n - at <= reach and (token := final.get(word[at:])) is not None:
                found.append(token)
                break
            for to in range(min(n - 1, at + reach), at, -1):
                if (token := inner.get(word[at:to])) is not None:
                    break
            found.append(token)
            at = to
        return found

    def exact(self, word: str) -> list[int]:
        """Merging by rank, leftmost first."""
        ids = [self.inner[c] for c in word[:-1]] + [self.final[word[-1]]]
        n = len(ids)
        after, before, join = list(range(1, n + 1)), list(range(-1, n - 1)), self.join
        heap = [(m, i) for i in range(n - 1) if (m := join.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            m, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or join.get((ids[i], ids[j])) != m:
                continue
            ids[i], ids[j] = m, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (new := join.get((ids[k], ids[after[k]]))) is not None:
                    heapq.heappush(heap, (new, k))
        return [x for x in ids if x >= 0]

    def exact_together(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merging by rank, leftmost first, of many words: (ids, lengths) of start symbols to those of tokens.

        A final symbol is never the left part of a merge, so no merge crosses
        from one word to the next and the words can stand in one array.
        """
        result = np.full(len(ids), -1, np.int64)
        counts = np.zeros(len(lengths), np.int64)
        words, place = np.arange(len(lengths)), np.arange(len(ids))
        rank = np.append(self._merged(ids[:-1], ids[1:]), self.size) if len(ids) else ids
        while len(words):
            starts = np.cumsum(lengths) - lengths
            best = np.minimum.reduceat(rank, starts)
            done = best == self.size
            if done.any():
                gone = np.repeat(done, lengths)
                result[place[gone]] = ids[gone]
                counts[words[done]] = lengths[done]
                ids, rank, place = ids[~gone], rank[~gone], place[~gone]
                words, lengths, best = words[~done], lengths[~done], best[~done]
                if not len(words):
                    break
            hits = np.flatnonzero(rank == np.repeat(best, lengths))
            owner = np.searchsorted(np.cumsum(lengths), hits, "right")
            at = hits[np.r_[True, owner[1:] != owner[:-1]]]
            ids[at] = best
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, rank, place = ids[keep], rank[keep], place[keep]
            lengths = lengths - 1
            # Each word lost one symbol, so the merged ones moved by the number of words before.
            at = at - np.arange(len(at))
            touched = np.union1d(at, np.maximum(at - 1, 0))
            after = np.minimum(touched + 1, len(ids) - 1)
            rank[touched] = np.where(touched + 1 < len(ids), self._merged(ids[touched], ids[after]), self.size)
        return result[result >= 0], counts

    def encode_joined(self, letters: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, number of ids of each word, words merged exactly) of words given as code points of their letters, one after the other."""
        if not len(lengths):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        last = np.cumsum(lengths) - 1
        marked = letters.astype("<u4")
        marked[last] += _LAST
        text = marked.tobytes().decode("utf-32-le")
        flat = np.fromiter((i for _, i in self.finder().iter_long(text)), np.int64)
        final = self.ends[flat]
        if final.sum() != len(lengths):
            raise ValueError("a word has letters that are no start symbols")
        counts = np.diff(np.r_[-1, np.flatnonzero(final)])
        owner = np.repeat(np.arange(len(lengths)), counts)
        wrong = np.zeros(len(lengths), bool)
        wrong[owner[~self.sound[flat]]] = True
        inside = np.flatnonzero(~final)
        pairs, at = np.unique(flat[inside] * self.size + flat[inside + 1], return_inverse=True)
        apart = self._apart(pairs // self.size, pairs % self.size, np.full(len(pairs), self.size, np.int64))
        wrong[owner[inside[~apart[at]]]] = True
        if not wrong.any():
            return flat, counts, 0
        # Failing words are merged from their letters; the results take the places of the proposals.
        found = dict.fromkeys(np.flatnonzero(wrong & (lengths > _TOGETHER)).tolist())
        for i in found:
            found[i] = np.array(self.exact("".join(map(chr, letters[last[i] + 1 - lengths[i] : last[i] + 1]))), np.int64)
        short = np.flatnonzero(wrong & (lengths <= _TOGETHER))
        spread = np.repeat(wrong & (lengths <= _TOGETHER), lengths)
        ids = self.inner_ids[letters[spread]]
        tails = np.cumsum(lengths[short]) - 1
        ids[tails] = self.final_ids[letters[last[short]]]
        merged, merged_counts = self.exact_together(ids, lengths[short])
        new_counts = counts.copy()
        new_counts[short] = merged_counts
        for i, x in found.items():
            new_counts[i] = len(x)
        out = np.empty(int(new_counts.sum()), np.int64)
        out[np.repeat(~wrong, new_counts)] = flat[~wrong[owner]]
        is_short = np.zeros(len(lengths), bool)
        is_short[short] = True
        out[np.repeat(is_short, new_counts)] = merged
        starts = np.cumsum(new_counts) - new_counts
        for i, x in found.items():
            out[starts[i] : starts[i] + len(x)] = x
        return out, new_counts, int(wrong.sum())

    def encode(self, words: list[str]) -> tuple[list[list[int]], int]:
        """The ids of each word, and how many words needed exact merging."""
        letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        flat, counts, exact = self.encode_joined(letters, np.fromiter(map(len, words), np.int64, len(words)))
        stops = np.cumsum(counts).tolist()
        return [flat[b - c : b].tolist() for b, c in zip(stops, counts.tolist(), strict=True)], exact


class WordTokenizer:
    """Encodes and decodes with a vocabulary file of words with end marks."""

    def __init__(self, path: str) -> None:
        import re

        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.merges = Merges(model["model"]["vocab"], map(tuple, model["model"]["merges"]))
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.pattern = regex.compile(rf"\n|{_WORD}")
        letters = byte_letters()
        self.byte_of = {c: b for b, c in enumerate(letters)}
        #: The code point of each byte's letter.
        self.letters = np.array([ord(c) for c in letters], "<u4")
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.merged_exactly = 0

    def _words_of(self, plain: list[str]) -> list[list[str]]:
        """The words of each normalised piece; those of all pieces that need cutting are found in one pass."""
        found: list[list[str]] = [[p] if p.isalpha() and (p.isascii() or max(p) < "ɐ") else [] for p in plain]
        rest = [i for i, p in enumerate(plain) if p and not found[i]]
        known = [i for i in rest if plain[i].isascii() or max(plain[i]) < "ɐ"]
        # A line break is in no word, so it can stand between the pieces.
        at = iter(known)
        words = found[next(at)] if known else []
        for w in self.pattern.findall("\n".join([plain[i].replace("\n", " ") for i in known])):
            if w == "\n":
                words = found[next(at)]
            else:
                words.append(w)
        # Newer scripts: the library's own tables say what is a letter.
        byte_of = self.byte_of
        for i in set(rest).difference(known):
            found[i] = [bytes([byte_of[c] for c in w]).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(plain[i])]
        return found

    def _normalised(self, pieces: list[str]) -> list[str]:
        """Each piece normalised; together, where the white space between them surely stays as it is."""
        normalise = self.library.normalizer.normalize_str
        simple = [p for p in pieces if p.isprintable() and " " not in p]
        together = normalise(" ".join(simple)).split(" ") if simple else []
        if len(together) != len(simple):
            return [normalise(p) for p in pieces]
        known = dict(zip(simple, together, strict=True))
        return [known[p] if p in known else normalise(p) for p in pieces]

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        split = self._words_of(self._normalised(pieces))
        known = self.words
        new = list({w for ws in split for w in ws}.difference(known))
        fresh: dict[str, bytes] = {}
        if new:
            # No word holds a line break: one between words, and one at the end, give their lengths.
            raw = np.frombuffer(("\n".join(new) + "\n").encode(), np.uint8)
            stops = np.flatnonzero(raw == 10)
            lengths = np.diff(np.r_[-1, stops]) - 1
            ids, counts, exact = self.merges.encode_joined(self.letters[raw[raw != 10]], lengths)
            self.merged_exactly += exact
            blob, to = ids.astype("<u4").tobytes(), (np.cumsum(counts) * 4).tolist()
            fresh = {w: blob[a:b] for w, a, b in zip(new, [0, *to[:-1]], to, strict=True)}
        out = {p: b"".join([fresh.get(w) or known[w] for w in ws]) for p, ws in zip(pieces, split, strict=True)}
        known.update((w, i) for w, i in fresh.items() if len(w) <= _LONGEST)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.pieces) > _REMEMBERED:
            self.pieces.clear()
        if len(self.words) > _REMEMBERED:
            self.words.clear()
        parts = [self.cut.split(t) if "<|" in t else [t] for t in texts]
        split = [[p if p in self.special else p.replace("\n", " ").split(" ") for p in ps] for ps in parts]
        wanted: set[str] = set()
        for ps in split:
            for p in ps:
                if isinstance(p, list):
                    wanted.update(p)
        known = self.pieces
        missing = wanted.difference(known)
        fresh = self._learn(list(missing))
        known.update(fresh)
        special = {t: np.array([i], "<u4").tobytes() for t, i in self.special.items()}
        out = [b"".join([special[p] if isinstance(p, str) else b"".join(map(known.__getitem__, p)) for p in ps]) for ps in split]
        for p in fresh:
            if len(p) > _LONGEST:
                del known[p]
        return out


class WordDecoder:
    """Token names of a vocabulary file; all that decoding needs."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        names = {i: t for t, i in model["model"]["vocab"].items()} | {t["id"]: t["content"] for t in model["added_tokens"]}
        # Every name with a space after it, one after the other, and where each begins.
        parts = [names.get(i, "").encode() + b" " for i in range(max(names) + 1)]
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def decode_bytes(self, ids: bytes) -> bytes:
        """The tokens' names in UTF-8, joined by spaces, as the file sets no decoder."""
        at = np.frombuffer(ids, "<u4")
        out = [self._gather(at[i : i + _GATHERED]) for i in range(0, len(at), _GATHERED)]
        return b"".join(out)[:-1]

    def _gather(self, at: np.ndarray) -> bytes:
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        return self.bytes[np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes()

    def decode(self, ids: bytes) -> str:
        return self.decode_bytes(ids).decode()


_LOADED: dict[tuple[type, str], WordTokenizer | WordDecoder] = {}


def _loaded(kind: type, path: str) -> WordTokenizer | WordDecoder:
    """The tokenizer or decoder of a file, loaded once a worker."""
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]


def tokenizer(path: str) -> WordTokenizer:
    return _loaded(WordTokenizer, path)


def decoder(path: str) -> WordDecoder:
    return _loaded(WordDecoder, path)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            yield batch.slice(at, _ROWS)


def _encode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Batches with ``ids`` in place of their last column, a text."""
    own = tokenizer(path)
    for part in _slices(batches):
        ids = own.encode([t or "" for t in part.column(part.num_columns - 1).to_pylist()])
        yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(ids, pa.binary())], [*part.schema.names[:-1], "ids"])


def _decode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Batches with one more column, the text of the column ``ids``."""
    own = decoder(path)
    for part in _slices(batches):
        texts = [own.decode(i.as_py() or b"") for i in part.column("ids")]
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"])


def _schema(rows: DataFrame, *without: str) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name not in without)


def encoded(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (binary, little-endian unsigned 32-bit) in place of the text column."""
    kept = [c for c in docs.columns if c not in (text, "ids")]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`"))
    return rows.mapInArrow(lambda batches: _encode_batches(batches, path), _schema(rows, text) + "ids binary")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` with one more column, ``decoded``: the text of the column ``ids``."""
    rows = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c != "decoded"])
    return rows.mapInArrow(lambda batches: _decode_batches(batches, path), _schema(rows) + "decoded string")


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for (doc_id, text): encoded and decoded in one pass, digests only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for part in _decode_batches(_encode_batches(batches, path), path):
            ids = part.column("ids").to_pylist()
            texts = part.column("decoded").to_pylist()
            columns = [
                part.column(0),
                pa.array([len(i) // 4 for i in ids], pa.int64()),
                pa.array([sha256(i).hexdigest() for i in ids], pa.string()),
                pa.array([sha256(t.encode()).hexdigest() for t in texts], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
