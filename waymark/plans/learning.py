"""Queries of learners and vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions import vectors
from waymark.operators import metrics, ml, splits
from waymark.plans.base import rounded, table


def embedding_norm_cosine(spark, sf):
    """Lengths of vectors, their guard and the cosine with the mean vector of their label."""
    vecs = table(spark, sf, "embeddings")
    size = F.size("embedding")
    parts = vecs.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centres = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))
    joined = vecs.join(centres, "label")
    return joined.select(
        "vec_id",
        F.round(vectors.norm(F.col("embedding")), 6).alias("norm"),
        (size > 0).alias("has_values"),
        F.round(vectors.cosine(F.col("embedding"), F.col("centre")), 6).alias("cosine"),
    )


NORM_SQL = """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings),
c AS (SELECT label, i, avg(x) AS m FROM e GROUP BY label, i), j AS (
    SELECT vec_id, sqrt(sum(x * x)) AS norm, sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) AS cosine FROM e JOIN c USING (label, i) GROUP BY vec_id)
SELECT vec_id, round(norm, 6) AS norm, true AS has_values, round(cosine, 6) AS cosine FROM j"""


def embedding_weighted_mean(spark, sf):
    """Weighted mean of unit vectors by label, scaled to length one (chunk pooling)."""
    vecs = table(spark, sf, "embeddings").withColumn("weight", (F.col("vec_id") % 3 + 1).cast("double"))
    items = vecs.select("label", "weight", F.posexplode(vectors.unit(F.col("embedding"))).alias("i", "x"))
    mean = items.groupBy("label", "i").agg((F.sum(F.col("x") * F.col("weight")) / F.sum("weight")).alias("m"))
    length = mean.groupBy("label").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("length"))
    return mean.join(length, "label").select("label", "i", F.round(F.col("m") / F.col("length") + 0.0, 6).alias("value"))


MEAN_SQL = """WITH e AS (SELECT vec_id, label, vec_id % 3 + 1 AS w, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding)))::INT AS i FROM embeddings),
n AS (SELECT vec_id, sqrt(sum(x * x)) AS l FROM e GROUP BY vec_id), m AS (SELECT label, i, sum(x / l * w) / sum(w) AS m FROM e JOIN n USING (vec_id) GROUP BY label, i),
s AS (SELECT label, sqrt(sum(m * m)) AS l FROM m GROUP BY label)
SELECT label, i, round(m / l + 0.0, 6) AS value FROM m JOIN s USING (label)"""


def dummy_baselines(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return ml.dummies(rows, "toxic", "lang").withColumn("prior", rounded(F.col("prior")))


DUMMIES_SQL = """SELECT lang, CASE WHEN avg(toxic) > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS most_frequent, round(avg(toxic), 9) AS prior FROM labels JOIN documents USING (doc_id) GROUP BY lang"""


def standard_scaler(spark, sf):
    """The rows of each fold in units of the other folds' statistics."""
    part = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    fold = F.col("p_partkey") % 4
    held = [ml.scaled(part.where(fold == k), ml.scaler(part.where(fold != k), ["size", "price"]), ["size", "price"]) for k in range(4)]
    return reduce(DataFrame.unionByName, held).select("p_partkey", F.round("size", 6).alias("size"), F.round("price", 6).alias("price"))


SCALER_SQL = """WITH f AS (SELECT k, avg(p_size) AS ms, stddev_pop(p_size) AS ss, avg(p_retailprice) AS mp, stddev_pop(p_retailprice) AS sp
    FROM part, range(4) t(k) WHERE p_partkey % 4 <> k GROUP BY k)
SELECT p_partkey, round((p_size - ms) / ss, 6) AS size, round((p_retailprice - mp) / sp, 6) AS price FROM part JOIN f ON p_partkey % 4 = k"""


def tfidf_weights(spark, sf):
    """The weights of every text's terms: words (T1), and words and pairs of words (T2)."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return ml.tfidf_variants(docs, "doc_id", "text", {"T1": 1, "T2": 2}).withColumn("weight", F.round("weight", 6))


TFIDF_SQL = r"""WITH words AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}_]{2,}') AS w FROM documents), grams AS (
    SELECT variant, doc_id, unnest(CASE variant WHEN 'T1' THEN w ELSE list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END) AS term
    FROM words, (VALUES ('T1'), ('T2')) v(variant)
), counts AS (
    SELECT variant, doc_id, term, count(*) AS tf FROM grams GROUP BY variant, doc_id, term
), vocabulary AS (
    SELECT variant, term, count(*) AS df FROM counts GROUP BY variant, term HAVING count(*) >= 2
    QUALIFY row_number() OVER (PARTITION BY variant ORDER BY sum(tf) DESC, term) <= 20000
), raw AS (
    SELECT variant, doc_id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS w FROM counts JOIN vocabulary USING (variant, term), (SELECT count(*) AS n FROM documents)
) SELECT variant, doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY variant, doc_id)), 6) AS weight FROM raw"""


def _features(spark, sf):
    docs = table(spark, sf, "documents")
    rows = docs.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    text = F.col("text")
    symbols = F.char_length(F.regexp_replace(text, "[^#*$%&|<>]", ""))
    words = F.greatest(F.size(F.split(text, r"\s+")), F.lit(1))
    return rows.select(
        "doc_id",
        "lang",
        "source",
        "quality",
        F.log1p(F.col("n_chars").cast("double")).alias("log_chars"),
        (symbols / words).alias("symbols"),
        (F.char_length(text) / words).alias("mean_word"),
    )


def lr_newton_oof(spark, sf):
    """Out-of-fold probabilities of two configurations; folds follow the source."""
    rows = splits.hash_folds(_features(spark, sf), "source", 3, 3, "lr")
    configs = [("C1", 1.0, False), ("C10_balanced", 10.0, True)]
    found = ml.out_of_fold(rows, "doc_id", ["log_chars", "symbols", "mean_word"], "quality", "fold", configs, 3)
    return found.withColumn("probability", F.round("probability", 6))


def nested_selection(spark, sf):
    """Outer scores of a learner whose configuration and threshold inner folds choose."""
    rows = _features(spark, sf).withColumns({"target": F.lit("quality"), "grp": F.concat_ws("::", "source", (F.col("doc_id") % 8).cast("string"))})
    manifest = splits.nested_manifest(rows, "target", "grp", "quality", 2026, (3, 2), (3, 2), starts=64)
    configs = [("C0.1", 0.1, False), ("C1", 1.0, False), ("C1_balanced", 1.0, True)]
    scored, _ = ml.nested(manifest, "doc_id", ["log_chars", "symbols", "mean_word"], "quality", configs, "target")
    return scored.withColumn("probability", F.round("probability", 6)).drop("status")


def metadata_onehot_lr(spark, sf):
    """A metadata-only learner: its ranking metrics by outer fold."""
    langs = ["de", "en", "es", "fr"]
    rows = ml.one_hot(splits.hash_folds(_features(spark, sf).drop("log_chars", "symbols", "mean_word"), "source", 3, 3, "lr"), {"lang": langs})
    named = rows.withColumnsRenamed({f"lang={x}": f"lang_{x}" for x in langs}).drop("lang")
    found = ml.out_of_fold(named, "doc_id", [f"lang_{x}" for x in langs], "quality", "fold", [("metadata", 1.0, False)], 3)
    ranked = metrics.ranking(found.withColumnRenamed("quality", "label"), "outer_fold", score="probability")
    return ranked.withColumns({c: F.round(c, 6) for c in ("prevalence", "average_precision", "ap_lift", "roc_auc")})


def blind_predictions(spark, sf):
    """Probabilities with the inclusive threshold and their guard."""
    rows = table(spark, sf, "part").select("p_partkey", (F.col("p_size") / 48).alias("probability"), F.lit(0.5).alias("threshold"))
    return ml.blind_predictions(rows, "probability", "threshold").groupBy("predicted_label", "inference_status").agg(F.count("*").alias("n"))


BLIND_SQL = """WITH p AS (SELECT p_size / 48.0::DOUBLE AS p FROM part)
SELECT CASE WHEN p BETWEEN 0 AND 1 THEN CAST(p >= 0.5 AS INT) END AS predicted_label, CASE WHEN p BETWEEN 0 AND 1 THEN 'ok' ELSE 'invalid' END AS inference_status, count(*) AS n FROM p GROUP BY ALL"""


def windowed_counts(spark, sf):
    """Event windows (an extension: the same plan runs on a stream)."""
    from waymark.streaming.windows import windowed_counts as counts

    found = counts(table(spark, sf, "events"), "1 day")
    return found.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


WINDOWS_SQL = "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"

QUERIES = {
    "embedding_norm_cosine": (embedding_norm_cosine, NORM_SQL),
    "embedding_weighted_mean": (embedding_weighted_mean, MEAN_SQL),
    "dummy_baselines": (dummy_baselines, DUMMIES_SQL),
    "standard_scaler": (standard_scaler, SCALER_SQL),
    "tfidf_weights": (tfidf_weights, TFIDF_SQL),
    "nested_selection": (nested_selection, None),
    "lr_newton_oof": (lr_newton_oof, None),
    "metadata_onehot_lr": (metadata_onehot_lr, None),
    "blind_predictions": (blind_predictions, BLIND_SQL),
    "windowed_counts": (windowed_counts, WINDOWS_SQL),
}
