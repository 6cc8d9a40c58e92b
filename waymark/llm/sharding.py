"""Sharding by extendible hashing.

Rows hash to ``BITS`` bits of a digest of their id and text. The directory
starts with one bucket; a bucket whose rows exceed the byte limit splits on the
next bit, and only such buckets do, until every shard fits. Levels are tried a
few bits at a time on sums per hash prefix, so a round is one aggregation of
the rows that are still in oversized buckets, and no row is moved for it. The
directory (prefix -> shard) is joined back on the prefix.

A shard that cannot be split (one row, or rows equal in id and text, beyond the
limit) is left as it is and marked ``oversized``.

A shard becomes a folder only where that gives at most ``MAX_FOLDERS`` of them;
:func:`write_shards` refuses a limit that asks for more.

Edge cases: a null or empty text has no bytes; a text of any length stays in one
shard; rows without doc_id hash by their text; repeated rows (and ties between
digests) share a shard; an empty table has no shards. :func:`sharded` uses no
other columns, so their names cannot clash; :func:`write_shards` keeps all
columns but an input column ``shard``, which it replaces.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import discard, stored

BITS = 60
MAX_FOLDERS = 100_000
_STEP = 12


def hash_bits(doc_id: Column, text: Column) -> Column:
    """The first BITS bits of a digest of id and text, as a long."""
    key = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _prefix(bits: Column, depth: Column | int) -> Column:
    return F.expr(f"shiftright(bits, {BITS - depth})") if isinstance(depth, int) else F.call_function("shiftright", bits, F.lit(BITS) - depth)


def directory(sized: DataFrame, limit: int) -> DataFrame:
    """``sized`` (bits, n_bytes, ...) with ``depth``, ``prefix``, ``shard_bytes`` and ``oversized`` of each row's shard."""
    found: list[DataFrame] = []
    open_rows = sized
    start = 0
    while True:
        # Depth 0, the whole table, is tried with the first step.
        end = start + _STEP
        cells = open_rows.groupBy(_prefix(F.col("bits"), end).alias("cell")).agg(F.sum("n_bytes").alias("cell_bytes"))
        levels = cells.select("cell", "cell_bytes", F.explode(F.sequence(F.lit(start + (start > 0)), F.lit(end))).alias("depth"))
        placed = levels.select("*", F.call_function("shiftright", F.col("cell"), F.lit(end) - F.col("depth")).alias("prefix"))
        sums = placed.groupBy("depth", "prefix").agg(F.sum("cell_bytes").alias("shard_bytes"))
        last = end == BITS
        fits = sums.where((F.col("shard_bytes") <= limit) | ((F.col("depth") == end) & F.lit(last)))
        of_cell = placed.select("cell", "depth", "prefix").join(fits, ["depth", "prefix"]).groupBy("cell")
        shards = stored(of_cell.agg(F.min(F.struct("depth", "prefix", "shard_bytes")).alias("s")), "directory")
        tagged = open_rows.withColumn("_cell", _prefix(F.col("bits"), end))
        done = tagged.join(shards.withColumnRenamed("cell", "_cell"), "_cell")
        found.append(done.select(*sized.columns, "s.*", (F.col("s.shard_bytes") > limit).alias("oversized")))
        open_rows = tagged.join(shards.select(F.col("cell").alias("_cell")), "_cell", "left_anti").drop("_cell")
        if last or open_rows.isEmpty():
            return reduce(DataFrame.unionByName, found)
        start = end


def sharded(docs: DataFrame, limit: int) -> DataFrame:
    """(doc_id, n_bytes, shard, depth, shard_bytes, oversized) for each row of (doc_id, text).

    shard: depth and prefix of the bucket, as ``depth-prefix``.
    """
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    sized = stored(docs.select("doc_id", n_bytes.alias("n_bytes"), hash_bits(F.col("doc_id"), F.col("text")).alias("bits")), "sizes")
    rows = directory(sized, limit)
    return rows.select("doc_id", "n_bytes", F.concat_ws("-", "depth", "prefix").alias("shard"), "depth", "shard_bytes", "oversized")


def write_shards(docs: DataFrame, limit: int, path: str) -> None:
    """Write ``docs`` as Parquet, a folder ``shard=...`` for each shard.

    The assignment joins back on the hash bits, which equal rows share.
    """
    kept = [c for c in docs.columns if c != "shard"]
    keyed = docs.select(*[F.col(f"`{c}`") for c in kept], hash_bits(F.col("doc_id"), F.col("text")).alias("_wm_bits"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    sized = stored(keyed.groupBy(F.col("_wm_bits").alias("bits")).agg(F.sum(n_bytes).alias("n_bytes")), "sizes")
    shards = directory(sized, limit).select(F.col("bits").alias("_wm_bits"), F.concat_ws("-", "depth", "prefix").alias("shard"))
    shards = stored(shards, "shards")
    many = shards.select("shard").distinct().count()
    if many > MAX_FOLDERS:
        raise ValueError(f"{many} shards: a folder for each is too many; raise the limit of bytes")
    keyed.join(shards, "_wm_bits").drop("_wm_bits").repartition("shard").write.partitionBy("shard").parquet(path)
    for table in (sized, shards):
        discard(table)
