import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators import bootstrap, metrics, ranking


def frame(spark, rows):
    return spark.createDataFrame(rows, "cell string, label int, score double, predicted int")


def brute_ap(y, p):
    total = sum(y)
    ap = 0.0
    before = 0
    for t in sorted(set(p), reverse=True):
        tp = sum(a for a, b in zip(y, p) if b >= t)
        ap += (tp - before) / total * tp / sum(b >= t for b in p)
        before = tp
    return ap


def brute_auc(y, p):
    pairs = [(a, b) for a, la in zip(p, y) for b, lb in zip(p, y) if la == 1 and lb == 0]
    return sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs)


def test_perfect_ranking_and_single_class(spark):
    rows = [("a", y, p, int(p >= 0.5)) for y, p in zip([0, 0, 1, 1], [0.1, 0.4, 0.6, 0.9])] + [("b", 0, 0.3, 0), ("b", 0, 0.9, 1)]
    found = {r.cell: r for r in metrics.bundle(frame(spark, rows), "cell").collect()}
    a, b = found["a"], found["b"]
    assert (a.average_precision, a.roc_auc, a.f1, a.mcc, a.prevalence) == (1.0, 1.0, 1.0, 1.0, 0.5)
    assert b.metric_status == "single_class" and b.average_precision is b.roc_auc is b.f1 is b.ap_lift is b.mcc is None
    assert (b.specificity, b.false_positive_rate, b.predicted_positive_rate, b.max_probability) == (0.5, 0.5, 0.5, 0.9)


@pytest.mark.parametrize("seed", range(4))
def test_ranking_with_ties_equals_brute_force(spark, seed):
    draw = np.random.default_rng(seed)
    y = draw.integers(0, 2, 60).tolist() + [0, 1]
    p = (draw.integers(0, 9, 62) / 8).tolist()
    r = metrics.ranking(frame(spark, [("c", a, b, 0) for a, b in zip(y, p)]), "cell").first()
    assert r.average_precision == pytest.approx(brute_ap(y, p), abs=1e-12)
    assert r.roc_auc == pytest.approx(brute_auc(y, p), abs=1e-12)


def test_weights_equal_copies(spark):
    rows = [("c", i % 2, i / 7, 0) for i in range(8)]
    weighted = frame(spark, rows).withColumn("w", (F.col("score") * 7).cast("int") % 3 + 1)
    copies = weighted.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("w"))))
    a = metrics.ranking(weighted, "cell", weight="w").first()
    b = metrics.ranking(copies, "cell").first()
    assert tuple(a)[:3] == tuple(b)[:3] and tuple(a)[3:] == pytest.approx(tuple(b)[3:], abs=1e-12)


def test_f1(spark):
    rows = [("c", y, 0.5, p) for y, p in zip([1, 1, 0], [1, 0, 1])]
    assert metrics.rates(metrics.confusion(frame(spark, rows), "cell")).first().f1 == 0.5


def test_grades(spark):
    df = spark.createDataFrame([(0.01, 0.1), (0.0, 0.1), (-0.1, 0.0)], "low double, point double")
    found = [r[0] for r in df.select(metrics.evidence_grade(F.col("low"), F.col("point"))).collect()]
    assert found == ["confirmed", "directional", "not_confirmed"]


def test_macro_counts_what_it_leaves_out(spark):
    cells = spark.createDataFrame([("t", "a", 0.5), ("t", "b", None), ("u", "a", 0.25)], "target string, cell string, m double")
    found = {r.target: tuple(r)[1:] for r in metrics.macro(cells, "m", "target").collect()}
    assert found == {"t": (0.5, None, 1, 1), "u": (0.25, None, 1, 0)}


def test_error_selection(spark):
    rows = [("e", f"key-{i}", 0.5 + (i + 1) / 100, 0.5) for i in range(6)]
    df = spark.createDataFrame(rows, "type string, key string, score double, threshold double")
    found = {r.selection: r.key for r in ranking.error_cases(df, ["type"], "key", "score", "threshold").collect()}
    assert found == {"nearest": "key-0", "median": "key-2", "farthest": "key-5"}
    ties = spark.createDataFrame([("e", k, 0.75, 0.5) for k in ("b", "a", "c")], "type string, key string, score double, threshold double")
    found = {r.selection: r.key for r in ranking.error_cases(ties, ["type"], "key", "score", "threshold").collect()}
    assert found == {"nearest": "a", "median": "b", "farthest": "a"}


def test_threshold_ties_prefer_the_middle(spark):
    df = frame(spark, [("c", 0, 0.2, 0), ("c", 1, 0.8, 0)])
    assert ranking.threshold_by_f1(df, "cell").first().threshold == 0.5


def test_cluster_draws_and_intervals(spark):
    scored = spark.createDataFrame([("c", f"g{i % 5}", i % 2, i / 20) for i in range(20)], "cell string, grp string, label int, score double")
    drawn = bootstrap.draws(scored, "cell", "grp", 50, 3)
    assert drawn.count() == 250 and drawn.exceptAll(bootstrap.draws(scored.orderBy(F.desc("score")), "cell", "grp", 50, 3)).isEmpty()
    turns = drawn.groupBy("bootstrap_id", "grp").agg(F.max("occurrence").alias("m"), F.count("*").alias("n"))
    assert turns.where("m <> n - 1").isEmpty()
    resampled = bootstrap.resampled_ranking(drawn, scored, "cell", "grp")
    rows = bootstrap.expanded(drawn, scored, "cell", "grp").groupBy("bootstrap_id").agg(F.count("*").alias("n2"), F.sum("label").alias("p2"))
    assert resampled.join(rows, "bootstrap_id").where("n <> n2 OR positives <> p2").isEmpty()
    values = spark.createDataFrame([(float(i),) for i in range(100)], "v double")
    r = bootstrap.intervals(values, "v").first()
    assert (r.low, r.high, r.valid_fraction) == pytest.approx((2.475, 96.525, 1.0))
    r = bootstrap.intervals(spark.createDataFrame([(1.0,), (None,), (2.0,), (None,)], "v double"), "v").first()
    assert (r.valid, r.invalid, r.valid_fraction) == (2, 2, 0.5)


def test_invalid_draw_is_null(spark):
    scored = spark.createDataFrame([("c", "a", 0, 0.2), ("c", "b", 1, 0.9)], "cell string, grp string, label int, score double")
    drawn = spark.createDataFrame([("c", 0, 0, "a", 0), ("c", 0, 1, "a", 1)], "cell string, bootstrap_id int, draw_position int, grp string, occurrence int")
    r = bootstrap.resampled_ranking(drawn, scored, "cell", "grp").first()
    assert r.n == 2 and r.average_precision is None


def test_paired_delta(spark):
    rows = [(0, "a", 1.0), (1, "a", 2.0), (0, "b", 0.25), (1, "b", 0.5)]
    df = spark.createDataFrame(rows, "draw int, method string, v double")
    assert sorted(r.delta for r in bootstrap.paired_delta(df, "v", "method", "a", "b", "draw").collect()) == [0.75, 1.5]


def test_retained_lift_and_dependency(spark):
    rows = [(0.2, 0.4), (0.0, 0.4), (-0.1, 0.4), (0.2, 0.0), (0.2, -1.0)]
    df = spark.createDataFrame(rows, "lift double, base double")
    assert [r[0] for r in df.select(metrics.retained_ratio(F.col("lift"), F.col("base"))).collect()] == [0.5, 0.0, 0.0, None, None]
    cases = [
        (0.49, 3, 2, 4, "strong_dependency"),
        (0.49, 2, 2, 4, "limited_dependency"),
        (0.49, 4, 1, 4, "limited_dependency"),
        (0.0, 4, 2, 5, "strong_dependency"),
        (0.5, 3, 0, 4, "moderate_dependency"),
        (0.5, 2, 2, 4, "limited_dependency"),
        (0.8, 4, 4, 4, "limited_dependency"),
        (None, 4, 4, 4, "not_assessable_nonpositive_s0_ap_lift"),
    ]
    df = spark.createDataFrame(cases, "ratio double, declines int, large int, domains int, expected string")
    found = df.select("expected", metrics.dependency(*[F.col(c) for c in ("ratio", "declines", "large", "domains")]).alias("d")).collect()
    assert all(r.d == r.expected for r in found)


def test_signal_grades(spark):
    schema = "t string, m string, f int, average_precision double, prevalence double, f1 double"

    def rows(t, ap, f1, folds):
        cells = [(t, "B0", 0, 0.5, 0.5, 0.6), (t, "B2", 0, ap, 0.5, f1)]
        for k, (a, b) in enumerate(folds, 1):
            cells += [(t, "B0", k, 0.5, 0.5, 0.6), (t, "B2", k, a, 0.5, b)]
        return cells

    good, bad = (0.7, 0.7), (0.7, 0.5)
    table = rows("clear", 0.8, 0.7, [good, good, bad]) + rows("one fold", 0.8, 0.7, [good, bad, bad])
    table += rows("none", 0.5, 0.6, [good, good]) + rows("ap only", 0.8, 0.6, [good, good, good]) + rows("null", None, None, [(None, None)])
    df = spark.createDataFrame(table, schema)
    found = metrics.signal_grades(df.where("f = 0"), df.where("f > 0"), "m", "f", ("B0", "B1"), ("B2", "B3"), "t").collect()
    assert dict(map(tuple, found)) == {
        "clear": "clear_provisional_signal",
        "one fold": "weak_or_mixed_signal",
        "none": "no_obvious_signal",
        "ap only": "weak_or_mixed_signal",
        "null": "no_obvious_signal",
    }
