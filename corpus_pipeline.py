"""The corpus pipeline: quality rules, line dedup, near dedup, substring dedup, packing.

Each stage takes the documents that its predecessor kept and returns a
DataFrame; all but the last return the columns of ``documents``.

Edge cases, in every stage: columns beyond those of ``documents`` are left out,
so their names cannot clash; an empty table gives an empty one; texts of any
length are read whole. Null and empty texts fail the quality rules; given to a
later stage by itself they pass it unchanged, and are packed as one piece that
holds the end id. Rows without doc_id pass line, near and substring dedup as the
operators' docstrings say. Repeated rows get equal verdicts from the quality
rules, lose the same lines and sentences, and all stay or all go in near dedup,
as they are one document there. Ties go to the smallest doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import line_templates, near_dedup, packing, quality_rules, span_dedup
from waymark.llm.support import SPACES, discard, stored, table
from waymark.shipping import shipped

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _recounted(rows: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    return rows.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def _has_words(text: str) -> Column:
    return F.char_length(F.translate(text, SPACES, "")) > 0


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned rules reject; null, empty and short texts fail the base rules."""
    rules = quality_rules.learn_from_labels(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judged(docs, rules).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; those of which no word is left go, null and empty texts stay as they are."""
    cleaned = line_templates.without_recurring_lines(docs)
    return _recounted(cleaned.where((F.col("n_dropped") == 0) | _has_words("text")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id; rows without one stay, as do empty texts."""
    found = near_dedup.similar_components(docs)
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated runs of sentences; those of which no word is left go, null and empty texts stay as they are."""
    cleaned = span_dedup.without_repeated_spans(docs)
    return _recounted(cleaned.where((F.col("n_removed") == 0) | _has_words("text")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the packed sequences; an empty text is a piece of one id."""
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", shipped(quality)),
    ("line_dedup", shipped(lines)),
    ("near_dedup", shipped(near_duplicates)),
    ("substring_dedup", shipped(spans)),
    ("packing", shipped(pack)),
]

#: Learned rules, min-max hashing and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs, before = table(spark, sf_dir, "documents").select(*COLUMNS), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
