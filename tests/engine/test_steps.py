from pyspark.sql import functions as F

from waymark.functions import steps

STEP = (
    "step_index int, action string, observation string, error string, reasoning string, focused_element string, "
    "tool_name string, tool_input string, tool_output string"
)
RECORD = f"key string, instruction string, signal string, steps array<struct<{STEP.replace(' int', ':int').replace(' string', ':string')}>>"


def features(spark, rows):
    df = spark.createDataFrame(rows, RECORD)
    found = steps.structural_features(F.col("steps"), F.col("signal"))
    return df.select(*[c.alias(n) for n, c in found.items()]).collect()


THREE = [
    (1, "  Click   Button ", "abc", None, "r", "button", None, None, None),
    (2, "Click Button", "abcdef", "failed", None, "", "grep", "x", "y\nz"),
    (3, "", "abcdefghi", None, None, None, None, None, None),
]


def test_feature_values(spark):
    (f,) = features(spark, [("k", "goal", "stop", THREE)])
    assert tuple(f)[:5] == (3, 2, 3, 1, 1)
    assert abs(f.natural_error_step_ratio - 1 / 3) < 1e-12
    assert (f.has_explicit_termination_signal, f.action_char_count_total, f.observation_char_count_total) == (1, 29, 18)
    assert (f.action_char_count_mean_nonempty, f.observation_char_count_mean_nonempty) == (14.5, 6.0)
    assert (f.unique_action_ratio, f.consecutive_duplicate_action_count) == (0.5, 1)


def test_empty_steps_have_zero_ratios(spark):
    (f,) = features(spark, [("k", "goal", None, [])])
    assert all(v == 0 for v in f)


def test_metadata_and_reasoning_do_not_matter(spark):
    other = [(i, a, o, e, "other", x, "t", "t", "t") for i, a, o, e, _, x, *_ in THREE]
    assert features(spark, [("k", "goal", "stop", THREE)]) == features(spark, [("other", "changed", "stop", other)])


def test_signal_is_not_inferred(spark):
    (f,) = features(spark, [("k", "g", None, [(1, "send_msg_to_user('x')", *[None] * 7)])])
    assert f.has_explicit_termination_signal == 0


def test_views_hide_what_they_must(spark):
    df = spark.createDataFrame([("k", "Do it", None, THREE)], RECORD)
    views = {v: df.select(steps.text_view(F.col("instruction"), F.col("steps"), v)).first()[0] for v in steps.VIEWS}
    assert views["primary_with_natural_errors"] == (
        "[TASK]\nDo it\n[STEP 1]\nACTION:\n  Click   Button \nOBSERVATION:\nabc\nFOCUSED_ELEMENT:\nbutton\n"
        "[STEP 2]\nACTION:\nClick Button\nOBSERVATION:\nabcdef\nTOOL_NAME:\ngrep\nTOOL_INPUT:\nx\nTOOL_OUTPUT:\ny\nz\nERROR:\nfailed\n"
        "[STEP 3]\nOBSERVATION:\nabcdefghi\n"
    )
    assert views["ablation_without_error_fields"] == views["primary_with_natural_errors"].replace("ERROR:\nfailed\n", "")
    assert [v for v, t in views.items() if "REASONING:\nr\n" in t] == ["sensitivity_with_reasoning"]


def test_a_step_without_fields_and_a_blank_task_are_not_shown(spark):
    rows = [("k", "", None, [(1, *[None] * 8), (2, " ", "", *[None] * 6), (3, None, None, "failed", *[None] * 5)])]
    df = spark.createDataFrame(rows, RECORD)
    views = [df.select(steps.text_view(F.col("instruction"), F.col("steps"), v)).first()[0] for v in steps.VIEWS]
    assert views == ["[STEP 2]\nACTION:\n \n[STEP 3]\nERROR:\nfailed\n", "[STEP 2]\nACTION:\n \n", "[STEP 2]\nACTION:\n \n[STEP 3]\nERROR:\nfailed\n"]


def test_blank_texts_count_no_characters(spark):
    (f,) = features(spark, [("k", "g", None, [(1, "   ", " ", *[None] * 6), (2, "go", None, *[None] * 6)])])
    assert (f.action_char_count_total, f.action_char_count_mean_nonempty, f.observation_char_count_total) == (2, 2.0, 0)


def test_last_nonempty(spark):
    df = spark.createDataFrame([("k", "g", None, THREE)], RECORD)
    s = F.col("steps")
    row = df.select(steps.last_nonempty(s, "action"), steps.last_nonempty(s, "observation"), steps.last_step_index(s)).first()
    assert tuple(row) == ("Click Button", "abcdefghi", 3)
