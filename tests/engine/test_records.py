import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators import records

RAW = "key string, instruction string, extra string, steps array<struct<action:string, observation:string, error:string, reasoning:string, focused_element:string, secret:string>>"


def test_cleaning_keeps_the_whitelist_and_flags(spark):
    steps = [(" go ", "", None, None, None, "x"), ("  ", "seen", "failed", None, "b", "y")]
    df = spark.createDataFrame([("k", " Goal\n", "e", steps), ("m", " ", "e", None)], RAW)
    k, m = records.cleaned(df).orderBy("key").collect()
    assert "secret" not in k.steps[0].asDict() and [s.step_index for s in k.steps] == [1, 2]
    assert (k.steps[0].action, k.steps[0].observation, k.steps[1].action, k.instruction) == ("go", None, None, "Goal")
    assert tuple(k.terminal) == ("go", "seen", 2)
    assert tuple(k.quality_flags) == (True, True, True, True, False, True)
    assert m.instruction is None and tuple(m.quality_flags) == (False,) * 6


def test_prediction_rules(spark):
    schema = "trajectory_key string, group_key string, held_out_group string, true_label int, predicted_probability double, selected_threshold double, predicted_label int"
    rows = [
        ("a::t::m", "a::t", "a", 1, 0.5, 0.5, 1),
        ("b::t::m", "a::t", "a", 1, 0.4, 0.5, 0),
        ("c::t::m", "c::t", "a", None, 1.5, 0.5, 0),
        ("d::t::m", "d::t", "d", 0, None, 0.5, 0),
    ]
    found = records.violations(spark.createDataFrame(rows, schema), "trajectory_key", records.prediction_rules()).collect()
    assert sorted(map(tuple, found)) == [
        ("b::t::m", "key_outside_group"),
        ("c::t::m", "group_outside_fold"),
        ("c::t::m", "label_not_binary"),
        ("c::t::m", "label_not_by_threshold"),
        ("c::t::m", "probability_range"),
        ("d::t::m", "probability_range"),
    ]


def test_model_reload_predicts_the_same(spark, tmp_path):
    model = records.LinearModel(("x", "y"), (0.5, 1.0), (2.0, 3.0), (0.25, -1.5), 0.125)
    model.save(spark, str(tmp_path / "m"))
    again = records.LinearModel.load(spark, str(tmp_path / "m"))
    assert again == model
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 5.0)], "x double, y double")
    assert [r[0] for r in df.select(model.probability()).collect()] == [r[0] for r in df.select(again.probability()).collect()]
    assert [tuple(r) for r in model.coefficients(spark).collect()] == [("y", -1.5, 1), ("x", 0.25, 2)]
    with pytest.raises(Exception, match="(?i)exists"):
        model.save(spark, str(tmp_path / "m"))


def test_digest_follows_values_not_order(spark):
    rows = [("m", i, i / 7) for i in range(20)]
    schema = "m string, k int, p double"
    a = records.probability_digest(spark.createDataFrame(rows, schema), "k", "p", "m").first().digest
    b = records.probability_digest(spark.createDataFrame(rows[::-1], schema), "k", "p", "m").first().digest
    c = records.probability_digest(spark.createDataFrame(rows[:-1] + [("m", 19, 2.71428571428572)], schema), "k", "p", "m").first().digest
    assert a == b != c
    expected = hashlib.sha256(np.array([p for *_, p in rows], "<f8").tobytes()).hexdigest()
    assert a == expected
    several = spark.createDataFrame([("m", i, i / 7) for i in range(20)] + [("n", i, 0.5) for i in range(3)] + [(None, 1, 1.0)], schema).repartition(5)
    found = {r.m: r.digest for r in records.probability_digest(several, "k", "p", "m").collect()}
    assert found["m"] == expected and found["n"] == hashlib.sha256(np.full(3, 0.5, "<f8").tobytes()).hexdigest() and len(found) == 3
    assert records.probability_digest(several.where("m = 'm'"), "k", "p").first().digest == expected


def test_variant_grid_and_wording(spark):
    grid = records.variant_grid(spark, {"S0": ["a", "b"], "S1": ["b"]}, ["a", "b"])
    assert sorted(map(tuple, grid.collect())) == [("S0", "a", 0, True), ("S0", "b", 1, True), ("S1", "a", 0, False), ("S1", "b", 1, True)]
    row = spark.range(1).select(records.status_text(F.lit("directional")).alias("t"), records.latest(F.lit(""), F.lit("x"), F.lit("y")).alias("l")).first()
    assert (row.t.section, row.t.forbidden, row.l) == ("results", "confirms", "x")
