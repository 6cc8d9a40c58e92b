"""Strict and lenient readers, write-once and ordered writers, state tables and file digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.operators.joins import IntegrityError, duplicate_keys, require_empty
from waymark.schemas import SEALED_PARTS


def strict_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file whose header and rows must fit the schema; anything else is an error."""
    wanted = T.StructType.fromDDL(schema).fieldNames()
    found = spark.read.option("header", True).csv(path).columns
    if found != wanted:
        raise IntegrityError(f"header {found} instead of {wanted}")
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)


def lenient_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; blanks stay empty."""
    return spark.read.option("header", True).option("nullValue", "\u0000").option("emptyValue", "").csv(path)


def keyed_jsonl(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """JSON lines with a unique key."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    require_empty(duplicate_keys(rows, key), f"{key} repeats")
    return rows


def json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def with_dead_letters(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, texts that could not be read) of JSON lines."""
    text = spark.read.text(path)
    parsed = text.select(
        F.col("value"), F.from_json("value", f"{schema}, _corrupt STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r")
    )
    good = parsed.where("r._corrupt IS NULL").select("r.*").drop("_corrupt")
    return good, parsed.where("r._corrupt IS NOT NULL").select(F.col("value").alias("text"))


def files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """(path, length, sha256) of the files under a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    if suffixes:
        found = found.where(F.col("path").rlike("(" + "|".join(s.replace(".", "\\.") for s in suffixes) + ")$"))
    return found.select("path", "length", F.sha2("content", 256).alias("sha256"))


def verify_digests(found: DataFrame, expected: DataFrame) -> None:
    """An error if a file (path, sha256) is missing or differs."""
    joined = expected.alias("e").join(found.alias("f"), "path", "left")
    require_empty(joined.where("f.sha256 IS NULL OR f.sha256 <> e.sha256").select("path"), "files differ")


def write_csv(rows: DataFrame, path: str, *order: str) -> None:
    """One ordered CSV file with a header; for results of a size that is read by people."""
    rows.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).option("lineSep", "\n").csv(path)


def write_once(rows: DataFrame, path: str) -> None:
    """Parquet that must not exist yet, unless it holds the same rows: then nothing is written."""
    spark = rows.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        before = spark.read.parquet(path)
        if before.columns != rows.columns or not before.exceptAll(rows).isEmpty() or not rows.exceptAll(before).isEmpty():
            raise IntegrityError(f"{path} exists and differs")
        return
    rows.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def write_jsonl(rows: DataFrame, path: str, key: str) -> None:
    """JSON lines in key order; part files are ordered among themselves too."""
    rows.orderBy(key).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def merged_state(previous: DataFrame, current: DataFrame, key: str, status: str) -> DataFrame:
    """Records of the current list with the state they had, and ``pending`` for new ones."""
    before = previous.select(key, F.col(status).alias("_before"))
    return current.join(before, key, "left").withColumn(status, F.coalesce("_before", F.lit("pending"))).drop("_before")


def to_do(current: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return current.join(done.select(key), key, "left_anti")


def sealed(rows: DataFrame) -> DataFrame:
    """``rows``; an error if a column's name tells of labels."""
    bad = [c for c in rows.columns if any(p in c.lower() for p in SEALED_PARTS)]
    if bad:
        raise IntegrityError(f"sealed table has {bad}")
    return rows
