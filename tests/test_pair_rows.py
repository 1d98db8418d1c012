"""Declared comparisons without a row per figure that a pair reads."""

from plumbline.operators import observe as ob

FIGURES = "component int, capture_ord int, figure_key string, value double, text string"
PAIRS = "component int, label string, form string, inputs array<string>, target string, tolerance double, percent boolean, min double, max double"


def _frames(spark):
    figures = spark.createDataFrame([
        (1, 0, "a", 2.0, None), (1, 0, "a", 3.0, None), (1, 0, "b", 5.0, None), (1, 1, "a", 4.0, None), (1, 1, "b", None, "$4K"),
        (1, None, "a", 1.0, None), (2, 0, "a", float("nan"), None), (2, 0, None, 1.0, None), (None, 0, "a", 1.0, None), (3, 0, "a", 1.0, None)], FIGURES)
    pairs = spark.createDataFrame([
        (1, "e", "equality", ["a", "b"], None, 0.0, False, None, None), (1, "s", "sum", ["a"], "b", 0.0, False, None, None),
        (2, "l", "bound", ["a"], None, None, None, 0.5, None), (2, "none", "sum", [], None, 0.0, False, None, None), (None, "x", "bound", ["a"], None, None, None, 0.5, None)], PAIRS)
    return figures, pairs


def test_repeated_missing_and_unreadable_figures(spark, rows):
    got = rows(ob.evaluate_pairs(*_frames(spark)), "component", "capture_ord", "label", "value_a", "value_b", "status")
    assert got == sorted([
        (1, 0, "e", 3.0, 5.0, "inconsistent"), (1, 0, "s", 5.0, 5.0, "consistent"), (1, 1, "e", 4.0, None, "not_comparable"), (1, 1, "s", 4.0, None, "not_comparable"),
        (1, None, "e", None, None, "not_comparable"), (1, None, "s", None, None, "not_comparable"), (2, 0, "l", None, 0.5, "not_comparable")], key=str)


def test_captures_meet_pairs_once(spark):
    plan = ob.evaluate_pairs(*_frames(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join" in line for line in plan.splitlines()) == 1
