"""Line dedup with a log-template tree of fixed depth.

A line's path in the tree is its token count and its first ``depth`` tokens.
Tokens that hold a digit are variable everywhere. At the leaf, every other token
is weighed by how many documents hold a line of the leaf with that token at that
place. A line keeps its best supported tokens, as many as make ``percent`` per
cent of its tokens without digits (the leading ones included), and all that are
as well supported as the least of these; the others turn variable. Two lines of
one template thus agree in at least that share of their tokens, whatever places
vary. A line whose tokens are not supported that far is its own template, and so
is one without any constant token. A template that occurs in at least
``min_docs`` documents recurs: its lines stay in the first document (smallest
doc_id) and are dropped from the others. Lines of one or two tokens follow the
same rule.

Everything is DataFrame expressions. Leaves in fewer documents than ``min_docs``
go first: a bitmap of fixed size, which is broadcast, keeps most of their lines
from being shuffled at all, and a join with the leaves drops the rest. Then equal
lines of a leaf are folded into one, so the places of a line that a third of all
documents share are counted once. Counts are made with map-side partial
aggregation; the joins are plain equi-joins with stored tables, whose skewed
partitions adaptive execution splits. Only one line's tokens are ever gathered
in one value. Texts are parsed twice, which costs less than keeping all lines.

Edge cases: null and blank texts have no lines and stay as they are; blank lines
are never dropped; lines and tokens may have any length; rows that share a doc_id
count as one document, and each loses its own recurring lines; rows without
doc_id count together as one document that comes after all others; ties between
supports keep all tied tokens; an empty table gives an empty one. Other columns
pass unchanged, whatever their names; ``n_lines``/``n_dropped`` replace input
columns of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import discard, likely_in, stored, without_positions

VARIABLE = "<*>"
_BLANKS = "[\\x20\\x09-\\x0D]+"
#: Columns that tell a row of documents: its id and 128 bits of a hash of its text.
_ROW = ("doc_id", "k1", "k2")


def _keys(text: str) -> list[Column]:
    return [F.xxhash64(text), F.xxhash64(F.lit(7), text)]


def _masked(token: Column) -> Column:
    return F.when(token.rlike("[0-9]"), F.lit(VARIABLE)).otherwise(token)


def parsed_lines(docs: DataFrame, depth: int = 2) -> DataFrame:
    """(doc_id, k1, k2, pos, leaf, whole, line) of every line that is not blank.

    line: its tokens between single spaces; leaf: a hash of its path in the tree; whole: one of the line.
    """
    k1, k2 = _keys("text")
    rows = docs.select("doc_id", k1.alias("k1"), k2.alias("k2"), F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    plain = F.trim(F.regexp_replace("raw", _BLANKS, " "))
    real = rows.where(F.col("raw").rlike("[^\\x20\\x09-\\x0D]"))
    # Generators: nothing that uses their columns computes them again.
    lines = real.select(*_ROW, "pos", F.explode(F.array(plain)).alias("line"))
    n = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    lead = F.substring_index("line", " ", depth)
    path = F.when(lead.rlike("[0-9]"), F.regexp_replace(lead, "[^ ]*[0-9][^ ]*", VARIABLE)).otherwise(lead)
    hashes = F.struct(F.xxhash64(n, path).alias("leaf"), F.xxhash64("line").alias("whole"))
    return lines.select(*_ROW, "pos", F.inline(F.array(hashes)), "line")


def _in_documents(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, docs, first_doc): in how many documents a key stands, and the first of them."""
    pairs = rows.groupBy(*keys, "doc_id").agg(F.lit(1).alias("_one"))
    return pairs.groupBy(*keys).agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))


def line_templates(lines: DataFrame, leaves: DataFrame, depth: int = 2, percent: int = 70, min_docs: int = 3) -> DataFrame:
    """(leaf, whole, template, constants) of the ``lines`` (doc_id, leaf, whole, line) whose leaf is in ``leaves``.

    template: a hash; constants: array<struct<pos, token>> of what is not variable after the leading
    tokens, null for a line that is its own template.
    """
    alike = likely_in(lines.select("doc_id", "leaf", "whole", "line"), "leaf", leaves, "leaf").join(leaves, "leaf")
    # One row for each distinct line of a leaf, with the number of documents that hold it.
    distinct = stored(_in_documents(alike, "leaf", "whole", "line").drop("first_doc"), "distinct")
    support = distinct.groupBy("leaf").agg(F.sum("docs").alias("leaf_docs"))
    tokens = F.split("line", " ")
    n_words = F.size(F.filter(tokens, lambda t: ~t.rlike("[0-9]")))
    n_lead = F.size(F.filter(F.slice(tokens, 1, depth), lambda t: ~t.rlike("[0-9]")))
    sized = distinct.select("leaf", "whole", n_words.alias("words"), n_lead.alias("lead"))
    places = distinct.select("leaf", "whole", "docs", F.posexplode(tokens).alias("pos", "token"))
    places = places.where((F.col("pos") >= depth) & ~F.col("token").rlike("[0-9]"))
    counted = places.groupBy("leaf", "pos", "token").agg(F.sum("docs").alias("weight")).where(F.col("weight") >= min_docs)
    known = places.select("leaf", "whole", "pos", "token").join(stored(counted, "places"), ["leaf", "pos", "token"])
    held = known.groupBy("leaf", "whole").agg(F.collect_list(F.struct("weight", "pos", "token")).alias("held"))
    # Constants that a line must find after its path.
    needed = F.greatest(F.lit(1), F.floor((F.lit(percent) * F.col("words") + 99) / 100)).cast("int") - F.col("lead")
    ranked = F.sort_array(F.transform(F.coalesce("held", F.array().cast("array<struct<weight:bigint,pos:int,token:string>>")), lambda h: h["weight"]), False)
    least = F.when(F.col("needed") <= 0, F.col("leaf_docs")).otherwise(F.get(ranked, F.col("needed") - 1))
    joined = sized.join(held, ["leaf", "whole"], "left").join(stored(support, "support"), "leaf").withColumn("needed", needed)
    chosen = F.filter(F.coalesce("held", F.array().cast("array<struct<weight:bigint,pos:int,token:string>>")), lambda h: h["weight"] >= F.col("least"))
    constants = F.sort_array(F.transform(chosen, lambda h: F.struct(h["pos"].alias("pos"), h["token"].alias("token"))))
    found = joined.withColumn("least", least).withColumn("constants", F.when(F.col("least").isNotNull(), constants))
    some = F.col("constants").isNotNull() & (F.size("constants") + F.col("lead") > 0)
    template = F.when(some, F.xxhash64("leaf", "constants")).otherwise(F.xxhash64("leaf", F.lit("line"), "whole"))
    return found.select("leaf", "whole", template.alias("template"), F.when(some, F.col("constants")).alias("constants"))


def dropped_lines(docs: DataFrame, depth: int = 2, percent: int = 70, min_docs: int = 3) -> DataFrame:
    """(doc_id, k1, k2, drop): ascending positions of the lines that go, by id and hashes of the text."""
    lines = stored(parsed_lines(docs, depth).drop("line"), "lines")
    leaves = stored(_in_documents(lines, "leaf").where(F.col("docs") >= min_docs).select("leaf"), "leaves")
    templates = stored(line_templates(parsed_lines(docs, depth), leaves, depth, percent, min_docs).drop("constants"), "templates")
    placed = stored(likely_in(lines, "leaf", leaves, "leaf").join(templates, ["leaf", "whole"]).select(*_ROW, "pos", "template"), "placed")
    # As a table of its own both sides of the join are shuffled for it alone, so a hot template's partition can be split.
    recurring = stored(_in_documents(placed, "template").where(F.col("docs") >= min_docs).select("template", "first_doc"), "recurring")
    hits = placed.join(recurring, "template").where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    found = stored(hits.groupBy(*_ROW).agg(F.sort_array(F.collect_set("pos")).alias("drop")), "drops")
    for table in (lines, leaves, templates, placed, recurring):
        discard(table)
    return found


def without_recurring_lines(docs: DataFrame, depth: int = 2, percent: int = 70, min_docs: int = 3) -> DataFrame:
    """``docs`` with cleaned ``text`` and the columns ``n_lines`` and ``n_dropped`` (non-blank lines)."""
    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    drops = dropped_lines(docs.select("doc_id", "text"), depth, percent, min_docs).toDF("_wm_id", "_wm_a", "_wm_b", "_wm_drop")
    k1, k2 = _keys("text")
    left = docs.select(*[F.col(f"`{c}`") for c in keep], k1.alias("_wm_k1"), k2.alias("_wm_k2"))
    same = F.col("doc_id").eqNullSafe(F.col("_wm_id")) & (F.col("_wm_k1") == F.col("_wm_a")) & (F.col("_wm_k2") == F.col("_wm_b"))
    joined = left.join(drops, same, "left")
    lines = F.split("text", "\n")
    cleaned = F.when(F.col("_wm_drop").isNull(), F.col("text")).otherwise(F.array_join(without_positions(lines, F.col("_wm_drop")), "\n"))
    n_lines = F.size(F.filter(lines, lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    return joined.select(
        *[cleaned.alias("text") if c == "text" else F.col(f"`{c}`") for c in keep],
        F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"),
        F.when(F.col("_wm_drop").isNull(), 0).otherwise(F.size("_wm_drop")).cast("long").alias("n_dropped"),
    )
