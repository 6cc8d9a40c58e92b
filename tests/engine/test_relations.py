import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.functions import scalar
from waymark.operators import inventory, joins, labels, ml, ranking, reporting, splits
from waymark.sources import files


def test_consensus_statuses(spark):
    rows = [("a", 1, "Yes"), ("b", 2, "Yes"), ("b", 1, "Yes"), ("c", 1, "No"), ("c", 2, "Yes"), ("d", 1, "Unsure"), ("d", 2, "No"), ("e", 1, "No")]
    df = spark.createDataFrame(rows, "k string, row_no int, v string")
    found = labels.resolved(labels.collapsed(df, "k", value="v", order="row_no", unsure="Unsure"), "Yes", "No")
    assert {r.k: (r.status, r.label) for r in found.collect()} == {
        "a": ("single_annotation", 1),
        "b": ("duplicate_agreement", 1),
        "c": ("duplicate_disagreement", None),
        "d": ("contains_unsure", None),
        "e": ("single_annotation", 0),
    }


def test_strict_join_refuses_losses_and_changes(spark):
    facts = spark.createDataFrame([(u, t, "m") for u in (1, 2) for t in "xyz"], "unit int, target string, model string")
    units = spark.createDataFrame([(1, "m"), (2, "m")], "unit int, model string")
    marks = spark.createDataFrame([(1, 0), (2, 1)], "unit int, label int")
    assert joins.strict_three_way(facts, units, marks, "unit", "model").count() == 6
    for bad_units, bad_marks in (
        (units.union(units.limit(1)), marks),
        (units.where("unit = 1"), marks),
        (units, marks.where("unit = 1")),
        (units.withColumn("model", F.lit("other")), marks),
    ):
        with pytest.raises(joins.IntegrityError):
            joins.strict_three_way(facts, bad_units, bad_marks, "unit", "model")


def test_task_id_rules_differ_at_the_end(spark):
    df = spark.createDataFrame([(" A.improved.3",), ("a.improved",), ("a.improvedx",), ("a.resized.1\t",), (" T.1.improved.resized ",)], "x string")
    found = [tuple(r) for r in df.select(scalar.normalize_task_id(F.col("x")), scalar.normalize_task_id(F.col("x"), True)).collect()]
    assert found == [("a.3", "a.3"), ("a.improved", "a"), ("a.improvedx", "ax"), ("a.1", "a.1"), ("t.1.resized", "t.1")]


def test_composite_key_reserves_its_delimiter(spark):
    df = spark.createDataFrame([("a", "b::c")], "x string, y string")
    with pytest.raises(Exception, match="key part"):
        df.select(scalar.composite_key(F.col("x"), F.col("y"))).collect()


def test_selection_does_not_depend_on_row_order(spark):
    rows = [("g", k, n) for k, n in (("b", 2), ("a", 2), ("c", 1), ("d", 1))]
    schema = "g string, k string, n int"
    a = ranking.first_by(spark.createDataFrame(rows, schema), ["g"], F.col("n"), F.col("k")).first()
    b = ranking.first_by(spark.createDataFrame(rows[::-1], schema), ["g"], F.col("n"), F.col("k")).first()
    assert a == b and a.k == "c"


def test_coverage_fill_adds_only_what_is_missing():
    rows = [{"k": k, "success": s, "loop": l} for k, s, l in (("a", 1, 0), ("b", 0, 1), ("c", 0, 0))]
    out = ranking.coverage_fill(rows[:1], rows, [("success", 1), ("success", 0), ("loop", 1), ("loop", 0)], ("k",))
    assert [r["k"] for r in out] == ["a", "b"]


def test_grouped_folds_are_disjoint_balanced_and_stable(spark):
    rows = [("t", f"g{i % 13}", int(i % 3 == 0), i) for i in range(130)]
    df = spark.createDataFrame(rows, "target string, grp string, label int, id int")
    a = splits.grouped_stratified(df, "target", "grp", "label", 4, seed=1, starts=8)
    assert a.groupBy("grp").agg(F.count_distinct("fold").alias("n")).where("n > 1").isEmpty()
    sizes = [r["count"] for r in a.groupBy("fold").count().collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 20
    b = splits.grouped_stratified(df.orderBy(F.desc("id")), "target", "grp", "label", 4, seed=1, starts=8)
    assert a.exceptAll(b.select(a.columns)).isEmpty()
    assert splits.grouped_stratified(df, "target", "grp", "label", (40, 5, 2), seed=1, starts=4).select("n_folds").distinct().collect()[0][0] == 5


def plain_assignment(groups, n, seed, namespace, starts):
    """The search in floating point, as its rule is worded."""

    def rank(*parts):
        return int.from_bytes(hashlib.sha256("|".join(map(str, parts)).encode()).digest()[:8], "big")

    totals = [sum(g[k] for g in groups.values()) for k in (0, 1)]
    rows = sum(totals)

    def uneven(folds):
        out = sum(sum((f[k] - totals[k] / n) ** 2 for f in folds) / max(totals[k], 1) for k in (0, 1))
        out += 0.15 * sum((f[2] - rows / n) ** 2 for f in folds) / max(rows, 1)
        return out + 0.05 * sum((f[3] - len(groups) / n) ** 2 for f in folds) / max(len(groups), 1)

    best = None
    for salt in range(starts):
        names = sorted(groups, key=lambda g: (-max(groups[g][0] / max(totals[0], 1), groups[g][1] / max(totals[1], 1)), -sum(groups[g]), rank(seed, namespace, salt, g)))
        folds, placed = [[0, 0, 0, 0] for _ in range(n)], {}
        for i, g in enumerate(names):
            add = (*groups[g], sum(groups[g]), 1)
            options = []
            for f in range(n):
                if i < n and folds[f][3]:
                    continue
                trial = [[x + a for x, a in zip(folds[f], add)] if k == f else folds[k] for k in range(n)]
                options.append((round(uneven(trial), 9), rank(seed, namespace + "|fold", salt, f"{g}|{f}"), f))
            f = min(options)[2]
            folds[f] = [x + a for x, a in zip(folds[f], add)]
            placed[g] = f
        if all(0 < f[k] < totals[k] for f in folds for k in (0, 1)):
            candidate = round(uneven(folds), 9), tuple(sorted(placed.items()))
            best = candidate if best is None else min(best, candidate)
    return dict(best[1]) if best else None


def test_grouped_folds_equal_the_plain_search(spark):
    draw = np.random.default_rng(4)
    rows = [("t", f"g{draw.integers(0, 11)}", int(draw.random() < 0.3), i) for i in range(90)]
    rows += [("few", f"g{i}", int(i == 0), i) for i in range(6)]
    df = spark.createDataFrame(rows, "target string, grp string, label int, id int")
    found = splits.grouped_stratified(df, "target", "grp", "label", (5, 3), seed=7, starts=20).collect()
    groups = {}
    for t, g, y, _ in rows:
        if t == "t":
            neg, pos = groups.get(g, (0, 0))
            groups[g] = (neg + (y == 0), pos + (y == 1))
    expected, n = next((a, n) for n in (5, 3) if (a := plain_assignment(groups, n, 7, "t", 20)) is not None)
    assert {r.grp: r.fold for r in found if r.target == "t"} == expected and {r.n_folds for r in found if r.target == "t"} == {n}
    # One positive row cannot be in every fold: no split, and no row is lost.
    assert [(r.fold, r.n_folds) for r in found if r.target == "few"] == [(None, None)] * 6


def test_nested_selection_keeps_validation_rows_apart(spark):
    draw = np.random.default_rng(5)
    rows = []
    for i in range(240):
        x, z = draw.normal(size=2)
        rows.append(("t", i, f"g{i % 24}", int(x + 0.5 * draw.normal() > 0), float(x), float(z)))
    df = spark.createDataFrame(rows, "target string, id int, grp string, label int, x double, z double")
    manifest = splits.nested_manifest(df, "target", "grp", "label", 3, (3,), (3, 2), starts=6).cache()
    assert manifest.count() == 720 and ml.leaked_keys(manifest, "grp", "target").isEmpty()
    assert manifest.where("outer_role = 'outer_validation'").groupBy("id").count().where("count <> 1").isEmpty()
    configs = [("weak", 1e-6, False), ("C1", 1.0, False), ("same", 1.0, False)]
    scored, candidates = ml.nested(manifest, "id", ["x", "z"], "label", configs, "target")
    chosen = {r.outer_fold: r.config for r in candidates.where("selected").collect()}
    local = manifest.toPandas()
    got = {r.id: r for r in scored.collect()}
    assert len(got) == 240
    for fold, part in local.groupby("outer_fold"):
        def scores(train, held, c):
            a, b = train.sort_values("id"), held
            mean, sd = a[["x", "z"]].mean().to_numpy(), a[["x", "z"]].std(ddof=0).to_numpy()
            w, _ = ml.newton_logistic((a[["x", "z"]].to_numpy() - mean) / sd, a["label"].to_numpy(), c, False)
            return 1 / (1 + np.exp(-(np.hstack([(b[["x", "z"]].to_numpy() - mean) / sd, np.ones((len(b), 1))]) @ w)))

        def precision(y, p):
            order = np.argsort(-p, kind="stable")
            hits = np.cumsum(y[order])
            return float((hits / np.arange(1, len(y) + 1))[y[order] == 1].mean())

        train, held = part[part.inner_split == "inner_train"], part[part.inner_split == "inner_validation"]
        aps = [round(precision(held["label"].to_numpy(), scores(train, held, c)), 12) for _, c, _ in configs]
        assert chosen[fold] == configs[aps.index(max(aps))][0]
        c = dict((n, v) for n, v, _ in configs)[chosen[fold]]
        outer = part[part.outer_role == "outer_validation"]
        for i, p in zip(outer["id"], scores(part[part.outer_role == "outer_train"], outer, c)):
            assert got[i].probability == pytest.approx(p, abs=1e-9) and got[i].predicted == int(got[i].probability >= got[i].threshold)


def test_tfidf_variants_strip_accents_and_pair_words(spark):
    docs = spark.createDataFrame([(1, "Été ÉTÉ x ete, fin"), (2, "ete fin"), (3, "fin ete"), (4, None)], "id int, text string")
    one = {(r.id, r.term): r.weight for r in ml.tfidf(docs, "id", "text").collect()}
    assert {k for k in one if k[0] == 1} == {(1, "ete"), (1, "fin")}
    a, b = (1 + np.log(3)) * (np.log(5 / 4) + 1), np.log(5 / 4) + 1
    assert one[1, "ete"] == pytest.approx(a / np.hypot(a, b))
    two = {r.term for r in ml.tfidf(docs, "id", "text", 2).where("id = 1").collect()}
    assert two == {"ete", "fin", "ete fin"}
    assert {r.term for r in ml.tfidf(docs, "id", "text", 1, max_df=0.5).collect()} == set()
    taught = docs.withColumn("fit", F.col("id") > 1)
    assert {r.term for r in ml.tfidf(taught, "id", "text", 2, fit_on="fit").where("id = 1").collect()} == {"ete", "fin"}


def test_json_paths(spark):
    text = '{"b": [1, {"x-1": true}], "a": {"9k": null, "Name": "v"}, "c": 1.5, "screenshot": "REMOVED"}'
    more = '{"steps": [{"image_url": ""}, {"image_url": "shots/1.png"}], "bounding_boxes": {"k": 1}}'
    df = spark.createDataFrame([(1, text), (2, "no json"), (3, None), (4, more)], "id int, j string")
    nodes = inventory.paths(spark, df, "j", "id")
    found = [(r.id, r.path, r.kind, r.value, r.size) for r in nodes.where("id < 4").collect()]
    assert sorted(found, key=repr) == sorted(
        [
            (1, "$", "dict", None, 4),
            (1, "$.a", "dict", None, 2),
            (1, "$.a.{*}", "null", "None", None),
            (1, "$.a.Name", "str", "v", None),
            (1, "$.b", "list", None, 2),
            (1, "$.b[]", "int", "1", None),
            (1, "$.b[]", "dict", None, 1),
            (1, "$.b[].x-1", "bool", "True", None),
            (1, "$.c", "float", "1.5", None),
            (1, "$.screenshot", "str", "REMOVED", None),
            (2, "$", "invalid", None, None),
        ],
        key=repr,
    )
    keys = {(r.id, r.key) for r in inventory.nested_keys(nodes, "id").collect()}
    assert {k for i, k in keys if i == 1} == {"a", "b", "c", "9k", "name", "x-1", "screenshot"}
    assert [tuple(r) for r in inventory.banned_keys(nodes, "id", ("NAME", "reward")).collect()] == [(1, "name")]
    flags = dict(map(tuple, inventory.screenshot_flags(nodes, "id").collect()))
    assert flags == {1: False, 2: False, 4: True}
    assert nodes.where("path = '$.bounding_boxes.{*}'").count() == 1
    examples = {(r.path, r.kind): r.example for r in inventory.inventory(nodes.where("id = 1"), "id").collect()}
    assert examples["$", "dict"] == "<object:keys=4>" and examples["$.b", "list"] == "<list:length=2>"
    assert (examples["$.b[]", "int"], examples["$.b[].x-1", "bool"], examples["$.a.{*}", "null"], examples["$.c", "float"]) == ("1", "True", "None", "1.5")
    assert examples["$.a.Name", "str"] == "<string:length=1:sha256=" + hashlib.sha256(b"v").hexdigest()[:12] + ">"


def test_first_rule_decides(spark):
    df = spark.createDataFrame([("$.reward_model",), ("$.model",), ("$.last_error",), ("$.goal",)], "path string")
    found = [(r.leakage_level, r.role, r.policy) for r in inventory.classified(df).collect()]
    assert found == [
        ("level_1", "model_metadata", "manual_review"),
        ("level_3", "model_metadata", "metadata_only"),
        ("level_3", "unclassified", "manual_review"),
        (None, "unclassified", "primary_input"),
    ]


def test_newton_solves_the_penalised_problem():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(200, 3))
    y = (x[:, 0] + 0.3 * draw.normal(size=200) > 0).astype(int)
    w, status = ml.newton_logistic(x, y, 2.0, True)
    assert status == "converged"

    def loss(v):
        z = np.hstack([x, np.ones((200, 1))]) @ v
        s = (200 / (2 * np.bincount(y)))[y]
        return 0.5 * v @ v + 2.0 * np.sum(s * np.logaddexp(0, np.where(y == 1, -z, z)))

    for i in range(4):
        for d in (-1e-3, 1e-3):
            moved = w.copy()
            moved[i] += d
            assert loss(moved) > loss(w)


def test_tfidf_equals_brute_force(spark):
    import math
    import re
    import unicodedata
    from collections import Counter

    docs = [(1, "The cat sat, the cat"), (2, "a cat and the Dog"), (3, "dog dog Ünïcode"), (4, "ünïcode x")]
    found = {(r.id, r.term): r.weight for r in ml.tfidf(spark.createDataFrame(docs, "id int, text string"), "id", "text").collect()}
    plain = {i: "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c)) for i, t in docs}
    counts = {i: Counter(re.findall(r"\b\w\w+\b", t)) for i, t in plain.items()}
    df = Counter(t for c in counts.values() for t in c)
    expected = {}
    for i, c in counts.items():
        raw = {t: (1 + math.log(n)) * (math.log(5 / (1 + df[t])) + 1) for t, n in c.items() if df[t] >= 2}
        length = math.sqrt(sum(v * v for v in raw.values()))
        expected |= {(i, t): v / length for t, v in raw.items()}
    assert found.keys() == expected.keys() and all(abs(found[k] - expected[k]) < 1e-12 for k in found)


def test_accents_are_stripped(spark):
    df = spark.createDataFrame([("Ünï é",), (None,)], "x string")
    assert [r[0] for r in df.select(ml.without_accents(F.col("x"))).collect()] == ["Uni e", None]


def test_score_roll_up(spark):
    rows = [("p", 4, 2, 50.0, False, None), ("p", 4, 4, 50.0, True, 60.0)]
    df = spark.createDataFrame(rows, "k string, primary_score int, adversarial_score int, weight double, cap_triggered boolean, cap_value double")
    r = reporting.weighted_score(df, "k").first()
    assert (r.raw_score, r.final_score) == (75.0, 60.0)


def test_decisions(spark):
    rows = [
        ("go", 80.0, 70.0, None, False, False),
        ("mend", 79.9, 70.0, False, False, False),
        ("mend", 80.0, 69.9, False, False, False),
        ("mend", 95.0, 95.0, False, True, False),
        ("mend", 95.0, 95.0, False, None, True),
        ("stop", 69.9, 95.0, False, False, False),
        ("stop", 95.0, 59.9, False, False, False),
        ("stop", 95.0, 95.0, True, True, False),
    ]
    df = spark.createDataFrame(rows, "e string, v double, c double, confirmed boolean, possible boolean, open boolean")
    found = df.select("e", reporting.decision(*[F.col(c) for c in ("v", "c", "confirmed", "possible", "open")]).alias("d")).collect()
    assert [r.d for r in found] == [{"go": "GO", "mend": "GO_WITH_MITIGATION", "stop": "NO_GO"}[r.e] for r in found]


def test_tables(spark):
    df = spark.createDataFrame([("a|b", None), ("50%_x", 1)], "x string, y int")
    assert reporting.markdown(df) == "| x | y |\n| --- | --- |\n| a\\|b | NA |\n| 50%_x | 1 |\n"
    assert reporting.latex(df) == "a|b & NA \\\\\n50\\%\\_x & 1 \\\\\n"


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", None), (1, "a", "x")], "k int, v string, w string")
    files.write_csv(df, str(tmp_path / "c"), "k")
    back = files.strict_csv(spark, str(tmp_path / "c"), "k int, v string, w string")
    assert [r.k for r in back.collect()] == [1, 2]
    with pytest.raises(joins.IntegrityError):
        files.strict_csv(spark, str(tmp_path / "c"), "v string, k int, w string")
    files.write_jsonl(df, str(tmp_path / "j"), "k")
    assert files.keyed_jsonl(spark, str(tmp_path / "j"), "k int, v string, w string", "k").count() == 2
    files.write_jsonl(df.union(df), str(tmp_path / "twice"), "k")
    with pytest.raises(joins.IntegrityError):
        files.keyed_jsonl(spark, str(tmp_path / "twice"), "k int, v string, w string", "k")
    files.write_once(df, str(tmp_path / "p"))
    files.write_once(df.orderBy("k"), str(tmp_path / "p"))
    with pytest.raises(joins.IntegrityError, match="differs"):
        files.write_once(df.where("k = 1"), str(tmp_path / "p"))
    with pytest.raises(joins.IntegrityError, match="differs"):
        files.write_once(df.drop("w"), str(tmp_path / "p"))
    found = files.files(spark, str(tmp_path / "p"), (".parquet",))
    assert found.count() >= 1
    files.verify_digests(found, found.select("path", "sha256"))
    with pytest.raises(joins.IntegrityError):
        files.verify_digests(found, found.select("path", F.lit("0").alias("sha256")))


def test_dead_letters_and_sealing(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"k": 1}\nnot json\n{"k": 2}\n')
    good, bad = files.with_dead_letters(spark, str(tmp_path / "x.json"), "k INT")
    assert sorted(r.k for r in good.collect()) == [1, 2] and [r.text for r in bad.collect()] == ["not json"]
    with pytest.raises(joins.IntegrityError):
        files.sealed(spark.createDataFrame([(1, 1)], "k int, success_label int"))


def test_streamed_windows_equal_batch(spark, tmp_path):
    from waymark.streaming.windows import windowed_counts

    events = spark.sql("SELECT timestamp_seconds(1700000000 + id * 977) AS ts, concat('t', id % 3) AS event_type, id * 0.5D AS value, id AS user_id FROM range(200)")
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    query = windowed_counts(stream, "1 hour").writeStream.outputMode("complete").format("memory").queryName("w").start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("SELECT * FROM w").exceptAll(windowed_counts(events, "1 hour")).isEmpty()
