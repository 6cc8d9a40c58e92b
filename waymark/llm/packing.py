"""Best-fit packing by patterns with non-negative least squares.

Documents become token ids plus an end id; only documents longer than the
capacity are cut, the remainder first. The histogram of piece lengths (at most
``capacity`` numbers) goes to the driver. There, patterns of one to three
lengths are enumerated: those that fill a sequence exactly, then those that
leave 1, 2, ... places free, level by level while there are fewer than
``MAX_PATTERNS``. Their repeat counts are fitted to the histogram by
non-negative least squares and rounded, the longest lengths first, with what a
length is owed carried on from pattern to pattern. What is left is packed
best-fit, longest first, on the histogram too; for that, some share of the
fitted repeats is left away, short pieces with long ones, and the share that
needs the fewest sequences is taken (among equals the largest). The plan says
for each length which ranks go to which sequences. Pieces get their ranks by a
count per length and salt, so pieces of one length, however many, are ranked in
parts of bounded size.

The plan's size depends on the capacity, not on the number of documents: there
are fewer than capacity**2 / 12 exact patterns, and best fit adds at most a few
groups for each length.

Edge cases: a null or empty text is one piece that holds the end id; texts of
any length are cut whole, a batch at a time; repeated rows are packed each for
itself; pieces of equal length are ranked by doc_id, piece and checksum, and
between equal ones any order gives the same result; rows without doc_id are
packed like others; no rows give no sequences. Other columns are not used, so
their names cannot clash.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_letters
from .support import stored

_ROWS = 256
#: Pieces that a worker remembers, and the longest that it does.
_REMEMBERED, _LONGEST = 700_000, 48
#: Levels of near-exact patterns are added while there are fewer patterns, and up to so many free places.
MAX_PATTERNS, MAX_FREE = 60_000, 4
#: Shares of the fitted repeats that are tried.
SHARES = (1.0, 0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6)
#: Fixed value: the pattern of byte-level vocabularies; every match is merged for itself.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteTokenizer:
    """Token ids as little-endian unsigned 32-bit integers, with the ids of space-led pieces remembered.

    A space that is followed by something else than white space always starts a
    token, so a text splits there into pieces that are encoded independently. A
    text where a space stands before white space or at the end, or that may hold
    a special token, goes to the library whole, as do long pieces and newer
    scripts; other pieces are merged by the faster of the two libraries, which
    takes its ranks from the same file. That one joins any neighbours that make
    up a token. Both give the same if every token is what merging its own bytes
    gives: then neighbours that make up a token are those that its merge names,
    as merges inside its bytes do not depend on what stands around them. This is
    checked when the file is loaded; where it fails, all pieces go to the library.
    """

    def __init__(self, path: str) -> None:
        import json
        import re

        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        merge, special = self.library.model.tokenize, set(self.library.get_added_tokens_decoder())
        vocab = {t: i for t, i in vocab.items() if i not in special}
        self.alike = all([m.id for m in merge(t)] == [i] for t, i in vocab.items())
        ranks = {bytes([byte_of[c] for c in t]): i for t, i in vocab.items()}
        self.fast = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = re.compile(r" (?=\s|\Z)")
        self.pieces: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _remember(self, wanted: set[str], known: dict[str, bytes], lead: str) -> list[str]:
        """Put the ids of new pieces (after ``lead``) into ``known``; those too long to keep are returned."""
        new = wanted.difference(known)
        merge = self.fast.encode_ordinary
        plain = [p for p in new if self.alike and len(p) <= _LONGEST and (p.isascii() or max(p) < "ɐ")]
        known.update((p, array("I", merge(lead + p)).tobytes()) for p in plain)
        others = list(new.difference(plain))
        known.update(zip(others, self._library([lead + p for p in others]), strict=True))
        return [p for p in others if len(p) > _LONGEST]

    def encode(self, texts: list[str]) -> list[bytes]:
        heads, known = self.heads, self.pieces
        for memory in (heads, known):
            if len(memory) > _REMEMBERED:
                memory.clear()
        direct = [i for i, t in enumerate(texts) if "<|" in t or self.whole.search(t)]
        out: list[bytes] = [b""] * len(texts)
        for i, ids in zip(direct, self._library([texts[i] for i in direct]), strict=True):
            out[i] = ids
        # The first piece of a text has no space before it, all others have.
        split = {i: texts[i].split(" ") for i in set(range(len(texts))).difference(direct)}
        firsts = {i: s.pop(0) for i, s in split.items()}
        wanted: set[str] = set()
        wanted.update(*split.values())
        long_heads = self._remember(set(firsts.values()), heads, "")
        long_pieces = self._remember(wanted, known, " ")
        for i, rest in split.items():
            out[i] = heads[firsts[i]] + b"".join(map(known.__getitem__, rest))
        for p in long_heads:
            del heads[p]
        for p in long_pieces:
            del known[p]
        return out


_LOADED: dict[str, ByteTokenizer] = {}


def tokenizer(path: str) -> ByteTokenizer:
    if path not in _LOADED:
        _LOADED[path] = ByteTokenizer(path)
    return _LOADED[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: whole where it fits, else the remainder and then full pieces."""
    first = (n - 1) % capacity + 1
    return [(0, first), *[(at, capacity) for at in range(first, n, capacity)]]


def pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) for (doc_id, text); ids: little-endian unsigned 32-bit."""
    closing = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                rows: list[tuple] = []
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc_id, ids in zip(part.column(0).to_pylist(), own.encode(texts), strict=True):
                    ids += closing
                    for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        piece = ids[4 * start : 4 * (start + length)]
                        rows.append((doc_id, k, start, length, crc32(piece), piece))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                arrays = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds[: len(names)])]
                yield pa.RecordBatch.from_arrays(arrays, names)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return slim.mapInArrow(run, schema)


def patterns(lengths: np.ndarray, capacity: int, most: int = MAX_PATTERNS, free: int = 0) -> np.ndarray:
    """Ascending triples of ``lengths`` that sum to the capacity; 0 stands for none.

    Then those that leave 1, 2, ... up to ``free`` places, each level whole, while there are fewer than ``most``.
    """
    have = np.zeros(capacity + 1, bool)
    have[lengths] = True
    have[0] = True
    low, mid = np.meshgrid(np.flatnonzero(have), np.flatnonzero(have), indexing="ij")
    levels: list[np.ndarray] = []
    for spare in range(free + 1):
        top = capacity - spare - low - mid
        good = (low <= mid) & (mid <= top) & (top > 0)
        good[good] = have[top[good]]
        levels.append(np.stack([low[good], mid[good], top[good]], axis=1))
        if sum(map(len, levels)) >= most:
            break
    return np.concatenate(levels)


def non_negative_least_squares(columns: np.ndarray, target: np.ndarray, weights: np.ndarray, rounds: int = 600) -> np.ndarray:
    """x >= 0 that minimises |W (A x - target)|, by accelerated projected gradients.

    A's column for a pattern counts its lengths; row 0 (no piece) does not count.
    """
    n = len(target)
    squares = weights**2
    x = np.zeros(len(columns))

    rows = [np.ascontiguousarray(columns[:, j]) for j in range(columns.shape[1])]

    def forward(v: np.ndarray) -> np.ndarray:
        total = sum(np.bincount(r, v, n) for r in rows)
        total[0] = 0
        return total

    def back(gap: np.ndarray) -> np.ndarray:
        weighed = gap * squares
        return sum(weighed[r] for r in rows)

    probe = np.ones(len(columns))
    for _ in range(20):
        probe = back(forward(probe))
        norm = np.linalg.norm(probe)
        if norm == 0:
            return x
        probe /= norm
    step = 1 / (1.05 * norm)
    y, t = x.copy(), 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(forward(y) - target))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best fit, longest first, on a histogram: (number of sequences, lengths in each)."""
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    spaces: list[int] = []

    def add(count: int, held: tuple[int, ...], space: int) -> None:
        if count:
            if space not in room:
                room[space] = []
                insort(spaces, space)
            room[space].append((count, held))

    for length in sorted((k for k, c in left.items() if c), reverse=True):
        todo = left[length]
        while todo:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                count, held = room[space].pop()
                if not room[space]:
                    del room[space], spaces[at]
                # Several of the same length go in where they fit, as one by one they would.
                k = min(space // length, -(-todo // count)) if space >= 2 * length else 1
                used = min(count, todo // k)
                add(count - used, held, space)
                add(used, (*held, *[length] * k), space - k * length)
                todo -= used * k
            else:
                k = min(capacity // length, todo)
                used = todo // k
                add(used, (length,) * k, capacity - k * length)
                todo -= used * k
    return [group for groups in room.values() for group in groups]


def _rounded(found: np.ndarray, x: np.ndarray, left: dict[int, int]) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns with whole repeats near ``x``, within ``left``, which is reduced by what they use.

    By greatest length, longest first; the fractions of a length's patterns add up until one repeat is owed.
    """
    groups = []
    owed, top = 0.0, 0
    used = np.flatnonzero(x > 1e-9)
    for i in used[np.lexsort((used, -x[used], -found[used, 2]))].tolist():
        held = tuple(int(k) for k in found[i] if k)
        if held[-1] != top:
            owed, top = 0.0, held[-1]
        owed += float(x[i])
        count = min(int(owed + 0.5), *[left[k] // held.count(k) for k in held])
        if count > 0:
            owed -= count
            groups.append((count, held))
            for k in held:
                left[k] -= count
    return groups


def plan(histogram: dict[int, int], capacity: int = 1024) -> list[tuple[int, tuple[int, ...]]]:
    """(number of sequences, lengths in each): every piece of the histogram has one place."""
    left = {k: int(c) for k, c in histogram.items() if c}
    full = left.pop(capacity, 0)
    groups = [(full, (capacity,))] if full else []
    if not left:
        return groups
    found = patterns(np.array(sorted(left)), capacity, free=min(MAX_FREE, capacity // 64))
    target = np.zeros(capacity + 1)
    target[list(left)] = list(left.values())
    scale = target.max()
    # Longer pieces weigh more, as they are harder to place.
    weights = np.sqrt(np.arange(capacity + 1) / capacity)
    x = non_negative_least_squares(found, target / scale, weights) * scale if len(found) else np.zeros(0)
    tries = []
    for share in SHARES:
        rest = dict(left)
        fitted = _rounded(found, share * x, rest)
        tries.append(fitted + best_fit(rest, capacity))
    return groups + min(tries, key=lambda t: sum(count for count, _ in t))


def slots(groups: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """Rows (length, first rank, sequence of that rank, offset), sorted: ranks go on with the sequences."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for count, held in groups:
        offset = 0
        for length in held:
            rows.append((length, used.get(length, 0), base, offset))
            used[length] = used.get(length, 0) + count
            offset += length
        base += count
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def _ranked(rows: DataFrame, part_rows: int = 50_000) -> DataFrame:
    """``rows`` with ``_rank``: 0, 1, 2, ... within each length."""
    parts = max(1, -(-rows.count() // part_rows))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    counted = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = salted.withColumn("_within", F.row_number().over(within) - 1)
    joined = numbered.join(offsets, ["length", "_salt"])
    return joined.withColumn("_rank", F.col("_before") + F.col("_within")).drop("_salt", "_within", "_before")


def placed(rows: DataFrame, capacity: int = 1024) -> DataFrame:
    """``rows`` (doc_id, piece, start, length, ids_crc32) with ``sequence_id`` and ``offset``."""
    histogram = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}
    table = slots(plan(histogram, capacity))
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(table)
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        # Ranks stay below 2**48, lengths below 2**15.
        keys = (own[:, 0] << 48) | own[:, 1]
        for batch in batches:
            at_length = columns.index("length")
            length = batch.column(at_length).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(len(columns)).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(keys, (length << 48) | rank, side="right") - 1
            sequence = own[at, 2] + rank - own[at, 1]
            extra = [pa.array(sequence, pa.int64()), pa.array(own[at, 3], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *extra], [*columns, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    ranked = _ranked(rows).select(*columns, F.col("_rank").cast("long"))
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def packed(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for (doc_id, text)."""
    return placed(stored(pieces(docs, path, capacity, end_id, with_ids=False), "pieces"), capacity)


def sequences(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """(sequence_id, n_tokens, ids) of the packed sequences; each holds ``capacity`` ids at most."""
    cut_up = pieces(docs, path, capacity, end_id)
    where = packed(docs, path, capacity, end_id)
    # Equal keys belong to equal pieces of repeated rows: number them alike on both sides.
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    copy = Window.partitionBy(*key)
    left = cut_up.withColumn("_copy", F.row_number().over(copy.orderBy("ids")))
    right = where.withColumn("_copy", F.row_number().over(copy.orderBy("sequence_id", "offset")))
    right = right.withColumnsRenamed({k: f"_{k}" for k in key} | {"_copy": "_of"})
    same = (F.col("_copy") == F.col("_of")) & F.col("doc_id").eqNullSafe(F.col("_doc_id"))
    for k in key[1:]:
        same &= F.col(k) == F.col(f"_{k}")
    met = left.join(right, same).groupBy("sequence_id")
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return met.agg(
        F.sum("length").alias("n_tokens"),
        F.aggregate(ordered, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
    )
