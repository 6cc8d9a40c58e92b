"""Text, key, hash and display queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import scalar, steps
from waymark.operators import reporting
from waymark.plans.base import records, rounded, table
from waymark.plans.records import views_sql


def literal_occurrences(spark, sf):
    """How often literals occur in texts, and in how many texts."""
    texts = table(spark, sf, "documents").select("doc_id", "text", "lang")
    literals = F.explode(F.array(*[F.lit(x) for x in ("the", "und", "token", "GNU")])).alias("literal")
    counted = texts.select("lang", literals, "text").withColumn("n", scalar.occurrences(F.col("text"), F.col("literal")))
    return counted.groupBy("lang", "literal").agg(F.sum("n").alias("occurrences"), F.count_if(F.col("n") > 0).alias("texts"))


LITERAL_SQL = """SELECT lang, literal, CAST(sum((length(text) - length(replace(text, literal, ''))) // length(literal)) AS BIGINT) AS occurrences,
    count(*) FILTER (contains(text, literal)) AS texts FROM (SELECT lang, text, unnest(['the', 'und', 'token', 'GNU']) AS literal FROM documents) GROUP BY lang, literal"""


def section_literals(spark, sf):
    """Literals by the section of a serialised record that they stand in.

    A line keeps the section of the last header before it; lines stay within
    their record, so this is array work and no shuffle follows the build.
    """
    view = steps.text_view(F.lit(None).cast("string"), F.col("steps"), "ablation_without_error_fields")
    lines = records(spark, sf).select("key", F.posexplode(F.split(view, "\n")).alias("pos", "line"))
    from pyspark.sql import Window

    head = F.nullif(F.regexp_extract("line", "^(ACTION|OBSERVATION|TOOL_NAME|TOOL_INPUT|TOOL_OUTPUT|FOCUSED_ELEMENT):$", 1), F.lit(""))
    head = F.when(F.col("line").rlike(r"^\[STEP [0-9]+\]$"), F.lit("STEP")).otherwise(head)
    w = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = lines.withColumn("section", F.coalesce(F.last(head, ignorenulls=True).over(w), F.lit("NONE")))
    literal = F.explode(F.array(F.lit("the"), F.lit("der"))).alias("literal")
    counted = placed.select("section", literal, "line").withColumn("n", scalar.occurrences(F.col("line"), F.col("literal")))
    return counted.groupBy("section", "literal").agg(F.count("*").alias("lines"), F.sum("n").alias("occurrences"))


SECTION_SQL = views_sql(
    r"""SELECT section, literal, count(*) AS lines, CAST(sum((length(line) - length(replace(line, literal, ''))) // length(literal)) AS BIGINT) AS occurrences FROM (
    SELECT line, unnest(['the', 'der']) AS literal, coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY key ORDER BY pos), 'NONE') AS section FROM (
        SELECT *, CASE WHEN regexp_full_match(line, '\[STEP [0-9]+\]') THEN 'STEP'
            ELSE nullif(regexp_extract(line, '^(ACTION|OBSERVATION|TOOL_NAME|TOOL_INPUT|TOOL_OUTPUT|FOCUSED_ELEMENT):$', 1), '') END AS head
        FROM (SELECT key, unnest(l) AS line, unnest(range(len(l))) AS pos FROM (SELECT key, string_split(coalesce(body, '') || chr(10), chr(10)) AS l FROM whole)))
) GROUP BY section, literal""",
    "['ablation_without_error_fields']",
)


def normalize_keys(spark, sf):
    """Task ids normalised two ways, and composite keys with their parts."""
    docs = table(spark, sf, "documents")
    raw = F.concat(F.lit(" Task."), F.element_at(F.array(F.lit("improved"), F.lit("resized"), F.lit("Plain")), (F.col("doc_id") % 3 + 1).cast("int")), F.lit("."), F.col("doc_id").cast("string"), F.lit(".improved \t"))
    task = scalar.normalize_task_id(raw)
    key = scalar.composite_key(F.col("source"), task, F.col("lang"))
    return docs.select("doc_id", task.alias("task_id"), scalar.normalize_task_id(raw, anywhere=True).alias("task_id_anywhere"), key.alias("key"), scalar.key_part(key, 1).alias("part"))


KEYS_SQL = """WITH r AS (SELECT doc_id, source, lang, 'task.' || ['improved', 'resized', 'plain'][doc_id % 3 + 1] || '.' || doc_id || '.improved' AS low FROM documents),
n AS (SELECT *, replace(replace(low, '.improved.', '.'), '.resized.', '.') AS task_id FROM r)
SELECT doc_id, task_id, replace(replace(low, '.improved', ''), '.resized', '') AS task_id_anywhere, source || '::' || task_id || '::' || lang AS key, task_id AS part FROM n"""


def canonical_hash(spark, sf):
    """Digests of canonical JSON, row ids and redacted values."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    found = reporting.fingerprint(docs, "source", "lang", "doc_id")
    return found.select("doc_id", "fingerprint", scalar.row_id(F.col("source"), F.col("lang")).alias("row_id"), scalar.redacted(F.col("text")).alias("example"))


HASH_SQL = """SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}') AS fingerprint,
    sha256(source || chr(31) || lang) AS row_id, '<string:length=' || length(text) || ':sha256=' || substr(sha256(text), 1, 12) || '>' AS example FROM documents"""


def display_rounding(spark, sf):
    """Fixed decimals half up, significant digits and mebibytes as they are shown."""
    part = table(spark, sf, "part")
    price = F.col("p_retailprice")
    return part.select(
        "p_partkey",
        scalar.fixed((price * 100).cast("long") / F.lit(100), 1).alias("one_decimal"),
        rounded(scalar.significant(price, 3)).alias("three_digits"),
        scalar.csv_cell(F.col("p_size") > 25, "boolean").alias("cell"),
        scalar.fixed(F.when(F.col("p_size") > 25, price), 3).alias("or_na"),
    )


ROUNDING_SQL = """WITH c AS (SELECT *, CAST(trunc(p_retailprice * 100) AS BIGINT) / 100.0::DOUBLE AS cents FROM part)
SELECT p_partkey, CAST(round(cents::DECIMAL(18, 6), 1)::DECIMAL(18, 1) AS VARCHAR) AS one_decimal,
    round(round(p_retailprice * pow(10.0, 2 - floor(log10(p_retailprice)))) / pow(10.0, 2 - floor(log10(p_retailprice))), 9) AS three_digits,
    CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END AS cell,
    coalesce(CAST(CASE WHEN p_size > 25 THEN round(p_retailprice::DECIMAL(18, 6), 3)::DECIMAL(18, 3) END AS VARCHAR), 'NA') AS or_na FROM c"""


def token_chunks(spark, sf):
    """Texts cut into windows of at most 100 words."""
    docs = table(spark, sf, "documents")
    words = F.filter(F.split("text", " "), lambda w: w != "")
    cut = docs.select("doc_id", scalar.chunks(words, 100).alias("chunks"))
    sizes = F.transform("chunks", lambda c: F.size(c))
    return cut.select("doc_id", F.size("chunks").alias("n_chunks"), F.aggregate(sizes, F.lit(0), lambda a, x: a + x).alias("n_words"), F.array_max(sizes).alias("largest"))


CHUNKS_SQL = """WITH w AS (SELECT doc_id, CAST(len(list_filter(string_split(text, ' '), lambda x: x <> '')) AS INT) AS n FROM documents)
SELECT doc_id, CAST(ceil(n / 100.0) AS INT) AS n_chunks, n AS n_words, CASE WHEN n > 0 THEN least(n, 100) END AS largest FROM w"""


def safe_paths(spark, sf):
    """Path predicate and interval parsing on urls."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    interval = F.concat(F.lit("0.5 (95% CI ["), F.col("page_id").cast("string"), F.lit(".25, "), (F.col("page_id") * 2).cast("string"), F.lit("])"))
    bounds = scalar.interval_bounds(interval)
    return pages.select("page_id", scalar.safe_path(F.col("url"), "https:", ".html", ("..", "en")).alias("safe"), bounds["low"].alias("low"), bounds["high"].alias("high"))


PATHS_SQL = """SELECT page_id, starts_with(url, 'https:') AND suffix(url, '.html') AND NOT list_has_any(string_split(url, '/'), ['..', 'en']) AS safe,
    page_id + 0.25::DOUBLE AS low, page_id * 2.0::DOUBLE AS high FROM pages"""


def marker_leaks(spark, sf):
    """Texts that hold a benchmark text, by item.

    White space ends a marker's inner words in any text that holds it, so its
    second to fourth words stand there as words. Only such three-word runs leave
    the texts, as hashes; the texts that share one are read again to check the
    whole marker. Markers of fewer than five words are looked for in all texts.
    """
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    markers = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("marker")).where("marker <> ''")
    split = F.split("marker", r"\s+")

    def run(words, at):
        return F.xxhash64(*[F.get(words, at + i) for i in range(3)])

    runs = docs.select("doc_id", F.split("text", r"\s+").alias("w")).where(F.size("w") >= 3)
    hashed = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: run(F.col("w"), i))))
    keyed = markers.where(F.size(split) >= 5).withColumn("run", run(split, F.lit(1)))
    candidates = runs.select("doc_id", hashed.alias("run")).join(keyed, "run").select("doc_id", "item_id", "marker").distinct()
    long = docs.join(candidates, "doc_id").where(F.contains("text", "marker")).select("item_id", "doc_id", "source")
    short = docs.join(markers.where(F.size(split) < 5), F.contains("text", "marker")).select("item_id", "doc_id", "source")
    return long.union(short).groupBy("item_id").agg(F.count_distinct("doc_id").alias("texts"), F.count_distinct("source").alias("sources"))


LEAKS_SQL = """SELECT item_id, count(DISTINCT doc_id) AS texts, count(DISTINCT d.source) AS sources
FROM benchmark b JOIN documents d ON b.text <> '' AND contains(d.text, b.text) GROUP BY item_id"""

def reference_keys(spark, sf):
    """Keys of bibliographies made of the documents' sources, and whether a key holds a number."""
    docs = table(spark, sf, "documents")
    entry = F.concat(F.lit("@article{"), F.col("source"), F.lit(", title={x}} @Book { k"), F.col("doc_id").cast("string"), F.lit(",}"))
    keys = docs.select("doc_id", F.explode(scalar.bibtex_keys(entry)).alias("key"))
    return keys.withColumn("numbered", scalar.has_number(F.col("key")))


REFERENCES_SQL = r"""SELECT doc_id, key, regexp_matches(key, '[0-9]') AS numbered FROM (SELECT doc_id, unnest(regexp_extract_all(
    '@article{' || source || ', title={x}} @Book { k' || doc_id || ',}', '@\w+\s*\{\s*([^,\s]+)', 1)) AS key FROM documents)"""


def allowed_rows(spark, sf):
    """Events of two types only, under other names."""
    from waymark.operators import records as record_operators

    return record_operators.allowed(table(spark, sf, "events"), "event_type", ("click", "view"), {"event_id": "id", "event_type": "stage", "value": "point"})


def record_bundles(spark, sf):
    """Digest and length of every view of the cleaned records."""
    from waymark.operators import records as record_operators

    return record_operators.bundles(record_operators.cleaned(records(spark, sf)), "key").drop("text")


def _bundles_sql() -> str:
    def cut(x: str) -> str:
        return f"nullif(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), '')"

    fields = ("action", "observation", "tool_name", "tool_output", "focused", "error", "reasoning")
    trimmed = ", ".join(f"{cut(f)} AS {f}" for f in fields)
    found = views_sql("SELECT key, view, array_to_string(list_filter(['[TASK]' || chr(10) || " + cut("task") + ", body], lambda x: x IS NOT NULL), chr(10)) || chr(10) AS t FROM whole")
    # Fields are stripped first, and steps are numbered anew.
    numbered = f"(SELECT key, turn, row_number() OVER (PARTITION BY key ORDER BY turn) AS step_index, {trimmed} FROM clean)"
    return f"SELECT key, view, sha256(t) AS content_sha256, length(t) AS characters FROM ({found.replace('AS view FROM clean', f'AS view FROM {numbered}')})"


QUERIES = {
    "reference_keys": (reference_keys, REFERENCES_SQL),
    "allowed_rows": (allowed_rows, "SELECT event_id AS id, event_type AS stage, value AS point FROM events WHERE event_type IN ('click', 'view')"),
    "record_bundles": (record_bundles, _bundles_sql()),
    "literal_occurrences": (literal_occurrences, LITERAL_SQL),
    "section_literals": (section_literals, SECTION_SQL),
    "normalize_keys": (normalize_keys, KEYS_SQL),
    "canonical_hash": (canonical_hash, HASH_SQL),
    "display_rounding": (display_rounding, ROUNDING_SQL),
    "token_chunks": (token_chunks, CHUNKS_SQL),
    "safe_paths": (safe_paths, PATHS_SQL),
    "marker_leaks": (marker_leaks, LEAKS_SQL),
}
