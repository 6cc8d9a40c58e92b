"""Near-duplicate documents by min-max hashing.

A document's set holds its distinct word shingles. Under each permutation both
the least and the greatest hash are kept, so a signature of ``2 * permutations``
values costs half the hash evaluations; signature rows of ``rows`` values are
banded. Documents meet in buckets, one for each band key; only links that are
confirmed on full sets join them:

1. texts -> (set size, 128-bit digest of the set, band keys); equal sets fold
   into one representative, so copies of any number cost one row from here on;
   buckets of the same members count once;
2. the members of all buckets with the same least member meet that one and, in
   parts of a bounded number of sets, each other. The links found there make
   components;
3. a bucket whose members are of one component is done. In any other one, the
   members outside of its largest component meet all its members, part by part;
   a part meets another part in one task. A bucket with very many such members
   is first cut into the buckets of a second, narrower banding;
4. connected components of all links, spread back over all copies.

So rows shuffled grow with the sizes of buckets, not of what buckets chain
together, and all pairs of a bucket that are not linked already are compared.

A pair of similarity s shares a band with probability s**rows; the parameters of
:func:`banding` put the chance to lose a link at the threshold below 1e-6, taken
that signature values agree independently. The least and the greatest hash of
small sets do not quite: for 7 against 6 shingles 1.24e-6 was measured.

Edge cases: a null or blank text has an empty set and is linked with nothing;
with fewer words than a shingle the whole sequence is one shingle; texts of any
length are hashed whole, a stretch at a time; rows that share a doc_id are one
document in the links, each with its own set size; a row without doc_id cannot
be named, so it gets no component and is kept; ties cannot occur, as the least
doc_id names a component; an empty table gives an empty one. Other columns are
not used, so their names cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .support import discard, likely_in, stored

#: Hashes of one step of a signature: bounds the memory that a long text needs.
_CHUNK = 2048
#: Words whose hashes a worker remembers.
_WORDS_KEPT = 400_000


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows) for a similarity of at least ``percent`` / 100: both fit in 190 signature values where that suffices."""
    for rows in range(8, 0, -1):
        agree = min(0.999, (percent / 100) ** rows)
        bands = math.ceil(math.log(1e-6) / math.log1p(-agree))
        if bands * rows <= 190 or rows == 1:
            return bands, rows
    raise AssertionError


def narrow_banding(percent: int, most: int = 1200) -> tuple[int, int]:
    """(bands, rows) of the second banding: as many rows a band as ``most`` signature values allow."""
    found = (1, 1)
    for rows in range(1, 40):
        agree = min(0.999, (percent / 100) ** rows)
        bands = math.ceil(math.log(1e-6) / math.log1p(-agree))
        if bands * rows > most:
            break
        found = bands, rows
    return found


class Shingler:
    """64-bit hashes of the distinct word shingles of texts."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        import xxhash

        found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not found:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > _WORDS_KEPT:
            known.clear()
        for word in set(found).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word)
        h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        n = max(1, len(h) - self.width + 1)
        mixed = np.full(n, len(h[: self.width]), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(min(self.width, len(h))):
                mixed = (mixed ^ h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(32)
            mixed *= np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed)


class MinMax:
    """Min-max signatures and their band keys."""

    def __init__(self, bands: int, rows: int, seed: int = 20_240_601) -> None:
        self.bands, self.rows = bands, rows
        draw = np.random.default_rng(seed)
        n = (bands * rows + 1) // 2
        self.scale = draw.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = draw.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1)
        self.mix = draw.integers(0, 2**63, rows, np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = draw.integers(0, 2**63, bands, np.uint64)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        low = np.full(len(self.scale), np.iinfo(np.uint64).max, np.uint64)
        high = np.zeros(len(self.scale), np.uint64)
        for at in range(0, len(hashes), _CHUNK):
            y = hashes[None, at : at + _CHUNK] * self.scale[:, None]
            y += self.shift[:, None]
            np.minimum(low, y.min(axis=1), out=low)
            np.maximum(high, y.max(axis=1), out=high)
        return np.stack([low, high], axis=1).ravel()

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """A 64-bit key per band; keys of different bands differ."""
        part = self.signature(hashes)[: self.bands * self.rows].reshape(self.bands, self.rows)
        key = self.salt.copy()
        for j in range(self.rows):
            key = (key ^ part[:, j]) * self.mix[j]
            key ^= key >> np.uint64(31)
        return key.view(np.int64)


def features(docs: DataFrame, width: int, bands: int, rows: int, seed: int = 20_240_601) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, bands) for each row of (doc_id, text); d1, d2: digest of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingle, minmax = Shingler(width), MinMax(bands, rows, seed)
        for batch in batches:
            n, d1, d2, keys, offsets = [], [], [], [], [0]
            for text in batch.column(1):
                s = shingle(text.as_py())
                digest = xxhash.xxh3_128_digest(s.tobytes())
                n.append(len(s))
                d1.append(int.from_bytes(digest[:8], "little", signed=True))
                d2.append(int.from_bytes(digest[8:], "little", signed=True))
                if len(s):
                    keys.append(minmax.keys(s))
                offsets.append(offsets[-1] + (bands if len(s) else 0))
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), listed]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "d1", "d2", "bands"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>")


def _set_bytes(rows: DataFrame, width: int) -> DataFrame:
    """``rows`` (node, text) with the text's set, as bytes, in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for batch in batches:
            sets = pa.array([shingle(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], ["node", "shingles"])

    return rows.mapInArrow(run, "node long, shingles binary")


def _linked(sets: list[np.ndarray], side: list[bool], percent: int) -> Iterator[tuple[int, int]]:
    """Links of a spanning forest of the pairs that are similar enough.

    ``side``: with both values present only pairs across are compared. Sets meet
    in an incidence matrix over the shingles that several of them hold; it is
    multiplied a stretch of columns at a time.
    """
    k = len(sets)
    if k < 2:
        return
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(k), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    start = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    times = np.diff(np.r_[start, len(flat)])
    column = np.repeat(np.arange(len(start)), times)
    shared = np.repeat(times > 1, times)
    column, owner = column[shared], owner[shared]
    if not len(column):
        return
    column = np.cumsum(np.r_[True, column[1:] != column[:-1]]) - 1
    both = np.zeros((k, k), np.int64)
    step = max(64, 4_000_000 // k)
    for at in range(0, int(column[-1]) + 1, step):
        here = slice(*np.searchsorted(column, [at, at + step]))
        matrix = np.zeros((k, min(step, int(column[-1]) + 1 - at)), np.float32)
        matrix[owner[here], column[here] - at] = 1
        both += (matrix @ matrix.T).astype(np.int64)
    near = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    flags = np.array(side)
    if flags.any() and not flags.all():
        near &= flags[:, None] != flags[None, :]
    root = list(range(k))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
        a, b = find(int(i)), find(int(j))
        if a != b:
            root[a] = b
            yield int(i), int(j)


def _confirm(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of sorted rows (group, low, high, side, node, shingles), group by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets, side = None, [], [], []

        def links() -> pa.RecordBatch:
            found = [(nodes[i], nodes[j]) for i, j in _linked(sets, side, percent)]
            ends = [pa.array([f[e] for f in found], pa.int64()) for e in (0, 1)]
            return pa.RecordBatch.from_arrays(ends, ["a", "b"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)
            rest = (batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5))
            for k, s, node, shingles in zip(keys, *rest, strict=True):
                if k != key:
                    if len(nodes) > 1:
                        yield links()
                    key, nodes, sets, side = k, [], [], []
                nodes.append(node)
                sets.append(np.frombuffer(shingles.as_py(), np.uint64))
                side.append(s)
        if len(nodes) > 1:
            yield links()

    return rows.mapInArrow(run, "a long, b long")


def _nodes(found: DataFrame) -> DataFrame:
    """(d1, d2, node, n_shingles, bands): one row for each set that is not empty; node: its least doc_id."""
    real = found.where("n_shingles > 0 AND doc_id IS NOT NULL")
    return real.groupBy("d1", "d2").agg(
        F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")
    )


def _buckets(keyed: DataFrame) -> DataFrame:
    """(key, least) of the buckets of (key, node) with several members; of those with the same members only one."""
    sign = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"sign{i}") for i in (0, 1)]
    found = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("least"), *sign).where("size > 1")
    return found.groupBy("least", "size", "sign0", "sign1").agg(F.min("key").alias("key")).select("key", "least")


def _texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the representatives ``nodes`` (node); most other texts are not shuffled."""
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    return likely_in(texts, "node", nodes, "node").join(nodes, "node")


def _parts(sizes: DataFrame, group: list[str], part_docs: int, part_shingles: int) -> DataFrame:
    """(group, parts): into how many parts the members of a group are cut, from (group, node, n)."""
    many = F.greatest(F.count("*") / part_docs, F.sum("n") / part_shingles)
    return sizes.groupBy(*group).agg(F.ceil(many).cast("int").alias("parts"))


def _part_of(parts: str) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(7)), F.col(parts)).cast("int")


def _meet(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the members (group, low, high, side, node) that meet in a task."""
    rows = pairs.join(sets, "node").select("group", "low", "high", "side", "node", "shingles")
    grouped = rows.repartition("group", "low", "high").sortWithinPartitions("group", "low", "high", "node")
    return _confirm(grouped, percent)


def _first_links(members: DataFrame, sizes: DataFrame, sets: DataFrame, percent: int, part_docs: int, part_shingles: int) -> DataFrame:
    """Links between the members of buckets with the same least member: with that one, and within parts."""
    around = members.where("node <> least").select(F.col("least").alias("group"), "node").distinct().join(sizes, "node")
    parts = _parts(around, ["group"], part_docs, part_shingles)
    own = around.join(parts, "group").select("group", _part_of("parts").alias("low"), "node")
    hubs = parts.select("group", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("low"), F.col("group").alias("node"))
    both = own.unionByName(hubs).withColumns({"high": F.lit(0), "side": F.lit(True)})
    return _meet(both, sets, percent)


def _open_buckets(members: DataFrame, components: DataFrame) -> DataFrame:
    """(key, node, main) of the buckets with members of several components; main: of the one with most members."""
    placed = members.select("key", "node").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    counts = placed.groupBy("key", "component").agg(F.count("*").alias("times"))
    largest = counts.groupBy("key").agg(F.count("*").alias("several"), F.max(F.struct("times", -F.col("component"))).alias("top"))
    open_ = largest.where("several > 1").select("key", (-F.col("top.col2")).alias("main"))
    return placed.join(open_, "key").select("key", "node", (F.col("component") == F.col("main")).alias("main"))


def _last_links(members: DataFrame, sizes: DataFrame, sets: DataFrame, percent: int, part_docs: int, part_shingles: int) -> DataFrame:
    """Links of members (key, node, main) outside of the main component with all members of their bucket."""
    sized = members.join(sizes, "node")
    parts = _parts(sized, ["key", "main"], part_docs, part_shingles)
    per = parts.groupBy("key").agg(
        F.max(F.when(F.col("main"), F.col("parts"))).alias("mains"), F.max(F.when(~F.col("main"), F.col("parts"))).alias("others")
    )
    placed = sized.join(per, "key").withColumn("part", F.when(F.col("main"), _part_of("mains")).otherwise(_part_of("others")))
    # Parts are numbered from 0 outside of the main component and from -1 downwards within it.
    outside = F.sequence(F.lit(0), F.col("others") - 1)
    inside = F.sequence(-F.col("mains"), F.lit(-1))
    met = F.when(F.col("main"), outside).otherwise(F.concat(outside, inside))
    number = F.when(F.col("main"), -1 - F.col("part")).otherwise(F.col("part"))
    meets = placed.select("key", "node", number.alias("part"), F.explode(met).alias("other"))
    pairs = meets.select(
        F.col("key").alias("group"),
        F.least("part", "other").alias("low"),
        F.greatest("part", "other").alias("high"),
        (F.col("part") < F.col("other")).alias("side"),
        "node",
    )
    return _meet(pairs, sets, percent)


def _narrowed(members: DataFrame, docs: DataFrame, width: int, percent: int, split: int) -> DataFrame | None:
    """Members (key, node), buckets of more than ``split`` members outside of the main component cut by the second banding.

    None where there is no such bucket.
    """
    counted = members.groupBy("key").agg(F.count_if(~F.col("main")).alias("others"))
    large = stored(counted.where(F.col("others") > split).select("key"), "large")
    if large.isEmpty():
        return None
    wide = stored(members.join(large, "key").select("key", "node"), "wide")
    texts = _texts_of(docs, wide.select("node").distinct()).select(F.col("node").alias("doc_id"), "text")
    keys = features(texts, width, *narrow_banding(percent), seed=20_250_917).select(F.col("doc_id").alias("node"), F.explode("bands").alias("second"))
    cut = wide.join(keys, "node").select(F.xxhash64("key", "second").alias("key"), "node")
    several = cut.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    return members.join(large, "key", "left_anti").select("key", "node").unionByName(cut.join(several, "key").select("key", "node"))


def similar_components(
    docs: DataFrame, width: int = 5, percent: int = 80, part_docs: int = 384, part_shingles: int = 1_000_000, split: int = 8192
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text).

    Links documents whose sets of ``width``-word shingles have a Jaccard
    similarity of at least ``percent`` / 100. component_id: the smallest doc_id
    reachable over links, itself included; kept: doc_id is that one.
    """
    found = stored(features(docs, width, *banding(percent)), "minmax")
    nodes = stored(_nodes(found), "sets")
    sizes = nodes.groupBy("node").agg(F.max("n_shingles").alias("n"))
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    # Stored, so both sides of the join are shuffled for it alone and a hot bucket's partition can be split.
    buckets = stored(_buckets(keyed), "buckets")
    members = stored(keyed.join(buckets, "key"), "members")
    several = members.select("node").distinct()
    sets = stored(_set_bytes(_texts_of(docs, several), width), "shingles")
    first = stored(_first_links(members, sizes, sets, percent, part_docs, part_shingles), "links")
    joined = stored(connected_components(first), "joined")
    open_ = stored(_open_buckets(members, joined), "open")
    narrowed = _narrowed(open_, docs, width, percent, split)
    if narrowed is not None:
        open_ = stored(_open_buckets(narrowed, joined), "open")
    last = stored(_last_links(open_, sizes, sets, percent, part_docs, part_shingles), "links")
    reached = connected_components(first.unionByName(last))
    placed = found.join(nodes.select("d1", "d2", "node"), ["d1", "d2"], "left").join(reached, "node", "left")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")).otherwise(F.col("doc_id"))
    result = placed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))
    result = stored(result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "components")
    for table in (found, nodes, buckets, members, sets, first, joined, open_, last):
        discard(table)
    return result
