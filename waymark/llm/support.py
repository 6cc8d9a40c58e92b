"""Expressions and storage helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII characters that separate words: space, tab, LF, VT, FF, CR.
SPACES = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    An expression that stands inside a lambda is evaluated for every element;
    binding it to a lambda variable of a one-element array avoids that.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def without_positions(pieces: Column, drop: Column) -> Column:
    """``pieces`` without the ascending, distinct 0-based positions ``drop``.

    Copies the stretches between dropped positions, so the work is linear in
    the number of pieces whatever the number of drops.
    """

    def build(p: Column, d: Column) -> Column:
        def stretch(j: Column) -> Column:
            start = F.when(j == 0, F.lit(0)).otherwise(F.get(d, j - 1) + 1)
            end = F.coalesce(F.get(d, j), F.size(p))
            return F.slice(p, start + 1, F.greatest(end - start, F.lit(0)))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(d)), stretch))

    return let(pieces, lambda p: let(drop, lambda d: build(p, d)))


#: Bits of the bitmap of likely_in(): 4 MB whatever the number of keys, so it can always be broadcast.
_BITS = 1 << 25


def likely_in(rows: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose ``column`` is not among ``keys``: whose bit of a hashed bitmap is not set.

    No row whose value is among them goes, rows with null do. To be used before a join that would shuffle all rows.
    """

    def slot(name: str) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(_BITS)) + 1

    bits = keys.groupBy(F.bitmap_bucket_number(slot(key)).alias("_wm_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot(key))).alias("_wm_bits"))
    found = rows.where(F.col(column).isNotNull())
    placed = found.withColumns({"_wm_bucket": F.bitmap_bucket_number(slot(column)), "_wm_place": F.bitmap_bit_position(slot(column))})
    byte = F.expr("CAST(conv(hex(substring(_wm_bits, CAST(_wm_place DIV 8 AS INT) + 1, 1)), 16, 10) AS INT)")
    bit = F.call_function("shiftright", byte, F.pmod("_wm_place", F.lit(8)).cast("int")).bitwiseAND(F.lit(1))
    return placed.join(F.broadcast(bits), "_wm_bucket").where(bit == 1).drop("_wm_bucket", "_wm_place", "_wm_bits")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` of the session; a temporary folder only where that
    is unset and the master is local (one machine), as in tests.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="waymark-")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def stored(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back.

    Cuts lineage with files that survive the loss of any executor, and gives
    later joins exact sizes.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`stored` that is not needed any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
