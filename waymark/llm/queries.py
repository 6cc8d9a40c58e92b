"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, line_templates, near_dedup, packing, quality_rules, sharding, span_dedup, transport_stream, url_filter
from .support import table

Query = Callable[[SparkSession, str], DataFrame]


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.formatted(table(spark, sf_dir, "conversations"))


def op2_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judged(pages).select("page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_terms")


def _op2_sql() -> str:
    words, rules = url_filter.Vocabulary(), url_filter.RULES

    def term(t: str) -> str:
        return f"regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')"

    # Occurrences whose edges touch share a character: two passes over doubled separators count them all.
    strict = " + ".join(
        f"len(regexp_extract_all(regexp_replace(low, '([^a-z0-9])', '\\1\\1', 'g'), '(^|[^a-z0-9]){t}([^a-z0-9]|$)'))" for t in words.strict
    )
    soft = " + ".join(f"CAST({term(t)} AS INT)" for t in words.soft)
    fits = "\n".join(
        f"        WHEN (host = '{r.host}' OR suffix(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.pattern}'"
        for r in sorted(rules, key=lambda r: (-len(r.pattern), r.pattern))
    )
    allowed = ", ".join(f"'{r.pattern}'" for r in rules if r.allow)
    lower = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return rf"""
WITH split AS (
    SELECT page_id, translate(coalesce(url, ''), {lower}) AS low,
        translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1), {lower}) AS host,
        regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1) AS path
    FROM pages
), judged AS (
    SELECT *, CASE
{fits}
        END AS rule, {strict} AS strict_hits, {soft} AS soft_terms
    FROM split
)
SELECT page_id, host, path, rule, CAST(strict_hits AS BIGINT) AS strict_hits, CAST(soft_terms AS BIGINT) AS soft_terms,
    CASE WHEN rule IS NOT NULL THEN CASE WHEN rule IN ({allowed}) THEN 'allow' ELSE 'block' END
        WHEN strict_hits > 0 OR soft_terms >= {words.enough} THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""


#: Bytes of text in a shard.
SHARD_BYTES = 1 << 20


def op3_extendible_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"), SHARD_BYTES)


OP3_SQL = f"""
WITH sized AS (
    SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes,
        CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, {sharding.BITS // 4}) AS BIGINT) AS bits
    FROM documents
), levels AS (
    SELECT doc_id, n_bytes, d AS depth, bits >> ({sharding.BITS} - d) AS prefix
    FROM sized, (SELECT CAST(unnest(range(0, {sharding.BITS + 1})) AS INT) AS d)
), sums AS (
    SELECT *, CAST(sum(n_bytes) OVER (PARTITION BY depth, prefix) AS BIGINT) AS shard_bytes FROM levels
)
SELECT doc_id, n_bytes, depth || '-' || prefix AS shard, depth, shard_bytes, shard_bytes > {SHARD_BYTES} AS oversized
FROM sums WHERE shard_bytes <= {SHARD_BYTES} OR depth = {sharding.BITS}
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1
"""


def op4_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport_stream.read_streams(transport_stream.kept_streams(table(spark, sf_dir, "documents")))


def op5_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.learn_from_labels(docs, table(spark, sf_dir, "labels"))
    judged = quality_rules.judged(docs.select("doc_id", "text"), rules)
    return judged.select(
        "doc_id", "n_words", F.col("n_word_chars").alias("word_chars"), "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


def op6_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op7_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_templates.without_recurring_lines(docs).select("doc_id", "n_lines", "n_dropped", "text")


#: A token with a digit is shown as the unit separator, which no token of the tables holds.
OP7_SQL = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS pos
    FROM documents WHERE text IS NOT NULL
), parsed AS (
    SELECT doc_id, pos, raw,
        list_filter(string_split(translate(raw, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda t: t <> '') AS tokens
    FROM lines
), shown AS (
    SELECT doc_id, pos, array_to_string(tokens, ' ') AS line,
        list_transform(tokens, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN chr(31) ELSE t END) AS masked
    FROM parsed WHERE len(tokens) > 0
), leafed AS (
    SELECT *, len(masked) || ' ' || array_to_string(masked[1:2], ' ') AS leaf FROM shown
), leaves AS (
    SELECT leaf FROM leafed GROUP BY leaf HAVING count(DISTINCT doc_id) >= 3
), alike AS (
    SELECT leaf, line, any_value(masked) AS masked, count(DISTINCT doc_id) AS docs FROM leafed SEMI JOIN leaves USING (leaf) GROUP BY leaf, line
), support AS (
    SELECT leaf, sum(docs) AS leaf_docs FROM alike GROUP BY leaf
), places AS (
    SELECT * FROM (SELECT leaf, line, docs, unnest(masked) AS token, unnest(range(1, len(masked) + 1)) AS p FROM alike) WHERE p > 2 AND token <> chr(31)
), weights AS (
    SELECT leaf, p, token, sum(docs) AS weight FROM places GROUP BY leaf, p, token HAVING sum(docs) >= 3
), supported AS (
    SELECT leaf, line, list({'p': p, 't': token, 'w': weight} ORDER BY p) AS held FROM places JOIN weights USING (leaf, p, token) GROUP BY leaf, line
), needs AS (
    SELECT leaf, line, coalesce(held, []) AS held, leaf_docs, len(list_filter(masked[1:2], lambda t: t <> chr(31))) AS lead,
        greatest(1, (70 * len(list_filter(masked, lambda t: t <> chr(31))) + 99) // 100) AS needed
    FROM alike JOIN support USING (leaf) LEFT JOIN supported USING (leaf, line)
), bounds AS (
    SELECT *, CASE WHEN needed <= lead THEN leaf_docs ELSE list_reverse_sort(list_transform(held, lambda h: h.w))[needed - lead] END AS least FROM needs
), constants AS (
    SELECT *, list_transform(list_filter(held, lambda h: h.w >= least), lambda h: h.p || ' ' || h.t) AS kept FROM bounds
), templates AS (
    SELECT leaf, line, CASE WHEN least IS NULL OR len(kept) + lead = 0 THEN 'line ' || line
        ELSE 'template ' || leaf || chr(30) || array_to_string(kept, chr(30)) END AS template
    FROM constants
), placed AS (
    SELECT doc_id, pos, template FROM leafed JOIN templates USING (leaf, line)
), recurring AS (
    SELECT template, min(doc_id) AS first_doc FROM placed GROUP BY template HAVING count(DISTINCT doc_id) >= 3
), gone AS (
    SELECT DISTINCT doc_id, pos FROM placed JOIN recurring USING (template) WHERE doc_id <> first_doc
), rebuilt AS (
    SELECT p.doc_id, count(*) FILTER (len(tokens) > 0) AS n_lines, count(g.pos) AS n_dropped,
        coalesce(string_agg(raw, chr(10) ORDER BY p.pos) FILTER (g.pos IS NULL), '') AS text
    FROM parsed p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.pos = g.pos GROUP BY p.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, r.text
FROM documents d LEFT JOIN rebuilt r USING (doc_id)
"""


def op8_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trips(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return span_dedup.without_repeated_spans(docs).select("doc_id", "n_sentences", "n_removed", "text")


def op10_min_max_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return near_dedup.similar_components(docs, width=3, percent=85)


OP10_SQL = r"""
WITH words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
    FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
    FROM words
), shingles AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
    SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), edges AS (
    SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reached AS (
    WITH RECURSIVE r(node, least) AS (
        SELECT doc_id, doc_id FROM sets UNION SELECT e.y, r.least FROM r JOIN edges e ON e.x = r.node
    ) SELECT node, min(least) AS component_id FROM r GROUP BY node
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN reached ON node = doc_id
"""


def queries() -> dict[str, Query]:
    return {
        "op1_role_repair": op1_role_repair,
        "op2_url_vocabulary": op2_url_vocabulary,
        "op3_extendible_hashing": op3_extendible_hashing,
        "op4_transport_stream": op4_transport_stream,
        "op5_decision_list": op5_decision_list,
        "op6_pattern_packing": op6_pattern_packing,
        "op7_line_templates": op7_line_templates,
        "op8_speculative_bpe": op8_speculative_bpe,
        "op9_sentence_spans": op9_sentence_spans,
        "op10_min_max_hash": op10_min_max_hash,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_vocabulary": _op2_sql(),
        "op3_extendible_hashing": OP3_SQL,
        "op7_line_templates": OP7_SQL,
        "op10_min_max_hash": OP10_SQL,
    }
