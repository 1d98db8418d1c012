"""Invariants, comparison, captured figures, results, metadata and plans on hand-sized frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.operators import compare, invariants, metadata, observe, regress, results
from plumbline.plans import registry


# --- invariants --------------------------------------------------------------------------


def test_assert_blank_counts_and_vacuous_bounds(spark):
    one = spark.createDataFrame([(None,)], "n double")
    assert invariants.assert_value(one, "n").first()["status"] == "passed"
    assert invariants.assert_value(one, "n", blank_as_zero=False).first()["status"] == "failed"
    assert invariants.assert_value(one.limit(0), "n").first()["status"] == "inconclusive"
    near = spark.createDataFrame([(0.4,)], "n double")
    assert invariants.assert_value(near, "n", "==", 0, tolerance=0.4).first()["status"] == "passed"
    assert invariants.assert_value(near, "n", "<=", 0, tolerance=0.4).first()["status"] == "failed"
    with pytest.raises(ValueError):
        invariants.assert_value(near, "n", ">=", 0, counts=True)
    with pytest.raises(ValueError):
        invariants.assert_value(near, "n", "=~", 0)
    with pytest.raises(ValueError):
        invariants.assert_value(near, "n", row=1)


def test_window_with_open_end(spark, rows):
    d = dt.date
    fact = spark.createDataFrame([(1, d(2024, 1, 5)), (1, d(2023, 12, 31)), (2, d(2024, 6, 1)), (3, d(2024, 1, 1)), (None, d(2024, 1, 1)), (4, d(2024, 1, 1))], "k int, day date")
    dim = spark.createDataFrame([(1, d(2024, 1, 1), d(2024, 1, 31)), (2, d(2024, 1, 1), None), (3, None, None)], "k int, s date, e date")
    assert rows(invariants.window_alignment(fact, dim, "k", "k", "day", "s", "e"), "day") == [(d(2023, 12, 31),)]
    assert invariants.window_alignment(fact, dim, "k", "k", "day", "s", "e", "outside").count() == 2
    assert rows(invariants.undated_events(fact, dim, "k", "k", "s"), "k") == [(3,), (4,)]


def test_name_churn_counts_a_missing_name(spark, rows):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "a"), (2, "a"), (3, None)], "k int, name string")
    assert rows(invariants.name_churn(df, "k", "name")) == [(1, 2, 2)]


def test_day_boundary_follows_daylight_saving(spark):
    df = spark.sql("select timestamp_ntz '2024-01-10 04:30:00' ts, date '2024-01-09' k union all select timestamp_ntz '2024-07-10 04:30:00', date '2024-07-10' union all select null, null")
    assert tuple(invariants.day_boundary(df, "ts", "k", tz="America/Toronto").first()) == (0, 3)
    assert tuple(invariants.day_boundary(df, "ts", "k").first()) == (1, 3)
    assert tuple(invariants.day_boundary(df, "ts", "k", offset_hours=-5).first()) == (1, 3)


def test_latest_version_ranks_before_it_filters(spark, rows):
    df = spark.createDataFrame([(1, 1, "won"), (1, 2, "cancelled"), (2, 1, "won")], "k int, v int, state string")
    assert rows(invariants.latest_version(df, ["k"], ["v"], eligible=F.col("state") == "won")) == [(2, 1, "won")]
    assert rows(invariants.latest_version(df, ["k"], ["v"], as_of=1), "state") == [("won",), ("won",)]


def test_join_amounts_with_a_hot_key(spark):
    base = spark.range(1000).select(F.lit(1).alias("k"), F.lit(2).cast("decimal(18,2)").alias("amount"))
    path = spark.range(1000).select(F.lit(1).alias("k"))
    got = {r["measure"]: (r["before"], r["after"]) for r in invariants.join_amount_check(base, path, ["k"], ["k"], ["amount"]).collect()}
    assert got == {"rows": (1000.0, 1e6), "amount": (2000.0, 2e6)}


def test_empty_days_and_periods(spark, rows):
    days = spark.sql("select date '2024-01-01' d union all select date '2024-01-03'")
    assert rows(invariants.empty_days(days, "d", end="2024-01-04")) == [(dt.date(2024, 1, 2),), (dt.date(2024, 1, 4),)]
    calendar = spark.sql("select date '2024-01-01' m, true done union all select date '2024-02-01', false")
    assert rows(invariants.flagged_complete_periods(calendar, days, "m", "done", "d"), "last_day") == [(dt.date(2024, 1, 31),)]


# --- comparison --------------------------------------------------------------------------


def test_keyed_compare_nulls_tolerance_and_keys(spark, rows):
    before = spark.createDataFrame([("a", 1.0), ("b", None), ("c", None), ("d", 5.0), ("e", 1.0), (None, 1.0)], "k string, v double")
    after = spark.createDataFrame([("a", 1.005), ("b", None), ("c", 2.0), ("e", 1.0051), ("f", 1.0), (None, 9.0)], "k string, v double")
    out = compare.keyed_compare(before, after, ["k"], ["v"])
    assert rows(out.changes, "k", "delta") == [("c", None), ("e", 0.0051), (None, 8.0)]
    assert rows(out.keys) == [("d", "removed"), ("f", "added")]
    assert out.verdict.first()["status"] == "different"
    assert compare.keyed_compare(before, before, ["k"], ["v"]).verdict.first()["status"] == "equal"
    assert compare.keyed_compare(before, before, ["k"], ["v"], complete=False).verdict.first()["status"] == "inconclusive"
    twice = compare.keyed_compare(before.unionByName(before), after, ["k"], ["v"]).verdict.first()
    assert (twice["status"], twice["reason"]) == ("inconclusive", "Duplicate comparison keys")
    with pytest.raises(ValueError):
        compare.keyed_compare(before, after, ["k"], ["v"], tolerance=-1)
    with pytest.raises(Exception):
        text = spark.createDataFrame([("a", "x")], "k string, v string")
        compare.keyed_compare(text, text, ["k"], ["v"]).verdict.collect()


def test_compare_does_not_narrow_types(spark, rows):
    before = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    after = spark.createDataFrame([("a", 1.4), ("b", 2.0)], "k string, v double")
    assert rows(compare.keyed_compare(before, after, ["k"], ["v"]).changes, "k", "delta") == [("a", 0.4)]


def test_closest_name_among_many_candidates(spark, rows):
    candidates = spark.createDataFrame([("M", f"column_{i}") for i in range(40)] + [("M", "amount"), ("N", "amounts")], "model string, candidate string")
    names = spark.createDataFrame([("M", "amout"), ("M", "zzz"), ("N", "amout")], "model string, name string")
    assert rows(metadata.closest_name(names, candidates, ["model"], "name")) == [("M", "amout", "amount"), ("M", "zzz", None), ("N", "amout", "amounts")]


# --- captured figures -----------------------------------------------------------------------


def figures(spark, values):
    return spark.createDataFrame([("p", c, k, k, None if v is None else float(v), t, t if t else str(v)) for c, k, v, t in values],
                                 "component string, capture_ord int, figure_key string, name string, value double, text string, display string")


def test_restored_replays_toggles_and_options(spark, rows):
    steps = [("capture", None, None, None, "base"), ("toggle_member", "S", "x", False, None), ("capture", None, None, None, "off"), ("toggle_member", "S", "x", False, None), ("toggle_member", "S", "x", True, None),
             ("select_option", "T", None, None, None), ("capture", None, None, None, "half"), ("select_option", "T", None, None, None), ("click_mark", "C", "bar", None, None), ("capture", None, None, None, "mark"),
             ("click_mark", "C", "bar", None, None), ("capture", None, None, None, "back")]
    df = spark.createDataFrame([("p", i, *step) for i, step in enumerate([("toggle_member", "S", "y", True, None)] + steps)], "component string, step_ord int, kind string, control string, member string, selected boolean, label string")
    assert rows(observe.restored_captures(df), "label", "restored") == [("back", True), ("base", True), ("half", False), ("mark", False), ("off", False)]
    assert observe.actions_between(df).groupBy("capture_ord").count().where("capture_ord = 2").first()["count"] == 3


def test_findings_cite_their_probe_files(spark):
    claims = [("PRB-a", "does not hold", "high", "dax.assert", "n: 1", "failed"), ("b", "", None, "dax.assert", "n: 2", "failed"), ("c", "", None, "dax.assert", "n: 0", "passed")]
    df = spark.createDataFrame(claims, "id string, expected string, severity string, detector string, observed string, status string")
    told = {r["id"]: r["evidence"] for r in results.failed_to_findings(df).collect()}
    assert told == {"FD-PRB-a": ["probes/a.json"], "FD-b": ["probes/b.json"]}
    own = df.withColumn("evidence", F.array(F.lit("kept.json")))
    assert {tuple(r["evidence"]) for r in results.failed_to_findings(own).collect()} == {("kept.json",)}


def test_captures_are_not_sent_through_the_driver(spark):
    """Repetitive steps make small files, by which Spark would broadcast every row of them."""
    steps = spark.range(2000).selectExpr("id as component", "explode(array(0, 1, 2)) as step_ord").withColumns({
        "kind": F.when(F.col("step_ord") == 1, "set_date").otherwise("capture"), "label": F.lit("x"), "selected": F.lit(None).cast("boolean")})
    acts = observe.actions_between(steps)
    shown = spark.range(2000).selectExpr("id as component", "explode(array(0, 1)) as capture_ord").withColumns({
        "figure_key": F.lit("n"), "value": F.lit(1.0), "display": F.lit("1"), "date_start": F.lit("2020-01-01").cast("date"), "date_end": F.lit("2020-01-02").cast("date"), "slicers": F.create_map(F.lit("S"), F.lit("a"))})
    told = acts.select("component", F.col("capture_ord"), F.lit(1).alias("actions"), "kind", "selected")
    frames = [acts, observe.direction_check(shown, shown, told), observe.changed_check(shown, told), observe.reset_check(shown, shown)]
    for frame in frames:
        assert "Broadcast" not in frame._jdf.queryExecution().sparkPlan().toString()
    assert acts.count() == 2000


def test_consistency_reasons(spark):
    f = figures(spark, [(0, "n", 66, None), (0, "d", 0, None), (0, "r", 3.3, None), (0, "k", None, "$240K")])
    assert observe.consistency_ratio(f, "n", "d", "r").first()["note"] == "the figure it is divided by is zero"
    assert observe.consistency_equality(f, "n", "k").first()["note"].startswith("the card shows an abbreviated value")
    assert observe.consistency_sum(f, ["n", "gone"], "r").first()["status"] == "not_comparable"
    assert observe.consistency_bound(f, "r", minimum=3.3).first()["status"] == "consistent"
    g = figures(spark, [(0, "n", 66, None), (0, "d", 1978, None), (0, "r", 3.3, None)])
    assert observe.consistency_ratio(g, "n", "d", "r", 0.05, percent=True).first()["status"] == "consistent"


def test_typed_expectations(spark, rows):
    observed = spark.createDataFrame([("c", "a", "1"), ("c", "b", "1.0"), ("c", "t", "true"), ("c", "l", '[1, {"x": 2, "y": null}]')], "capture string, pointer string, value string")
    expected = spark.createDataFrame([("c", "a", "1.0"), ("c", "b", "1.00"), ("c", "t", "1"), ("c", "l", '[1, {"y": null, "x": 2}]'), ("c", "gone", "1")], "capture string, pointer string, value string")
    got = {r["pointer"]: r["status"] for r in observe.check_expectations(observed, expected).collect()}
    assert got == {"a": "failed", "b": "passed", "t": "failed", "l": "passed", "gone": "failed"}


# --- regression and results ---------------------------------------------------------------------


def test_unknown_classifications_are_refused(spark):
    claims = spark.createDataFrame([("a",), ("b",)], "id string")
    bad = spark.createDataFrame([("z", "preserved", None)], "id string, change_classification string, note string")
    with pytest.raises(Exception, match="unknown claim z"):
        regress.classify_changes(claims, bad).collect()
    assert regress.classify_changes(claims, bad, strict=False).where("problem is not null").count() == 1
    good = spark.createDataFrame([("a", " New Regression ", "x")], "id string, change_classification string, note string")
    assert regress.classify_changes(claims, good).where("change_classification = 'new regression'").count() == 1


def test_ranking_order(spark):
    claims = spark.createDataFrame([
        ("c1", "dax.assert", "e", "dax.assert: Observed 5 == expected 0: does not hold", "failed", "high"), ("c2", "dax.assert", "e", "dax.assert: Observed 1,534 == expected 0: does not hold", "failed", "high"),
        ("c3", "lint.x", "e", "2 objects", "inconclusive", "low"), ("c4", None, "e", "?", "inconclusive", None), ("c5", None, "e", "fine", "passed", "critical"), ("c6", None, "e", "bad", "failed", "low")],
        "id string, detector string, expected string, observed string, status string, severity string")
    findings = spark.createDataFrame([("f1", "Worst", "critical", ["c6"], "x"), ("f2", "Alone", "medium", ["c5"], "x")], "id string, title string, severity string, claim_ids array<string>, explanation string")
    components = spark.createDataFrame([("p", "Page", "c1")], "component string, name string, claim_id string")
    assert [r["id"] for r in results.rank_findings(claims, findings, components).collect()] == ["c6", "c2", "c1", "f2", "c4", "c3", "c5"]


def test_plan_failures_stay_apart(spark):
    probes = [registry.Probe("ok", "dax.assert", "select 0 as n", {"column": "n", "value": 0}), registry.Probe("div", "dax.assert", "select 1 / 0 as n", {"column": "n", "value": 0}),
              registry.Probe("method", "stat.nothing", "select 1"), registry.Probe("hole", "dax.assert", "select count(*) as n from <fact>", {})]
    got = {r["probe"]: (r["status"], r["error"]) for r in registry.run_plan(spark, probes).collect()}
    assert got["ok"] == ("passed", None)
    assert got["div"][0] == got["method"][0] == got["hole"][0] == "inconclusive" and "DIVIDE_BY_ZERO" in got["div"][1] and "unknown method" in got["method"][1]


def test_catalog_has_the_whole_list(spark):
    catalog = registry.catalog_frame(spark)
    assert catalog.count() == 22 and catalog.select("id").distinct().count() == 22


# --- metadata --------------------------------------------------------------------------------------


def test_closure_survives_cycles_and_stops_at_depth(spark, rows):
    chain = [(f"m{i}", f"[m{i + 1}]") for i in range(6)] + [("m6", "SUM(fact_deep[x])"), ("a", "[b] + SUM('dim_a'[x])"), ("b", "[a] / [b]")]
    measures = spark.createDataFrame([("M", "t", n, e, None) for n, e in chain], "model string, table string, measure string, expression string, format string")
    tables = spark.createDataFrame([("M", "fact_deep"), ("M", "dim_a")], "model string, table string")
    whole = rows(metadata.measure_closure(measures, tables), "measure", "table", "level")
    assert ("m0", "fact_deep", 6) in whole and ("m1", "fact_deep", 5) in whole
    closure = metadata.measure_closure(measures, tables, depth=4)
    assert rows(closure, "measure", "table", "level") == [("a", "dim_a", 0), ("b", "dim_a", 1), ("m2", "fact_deep", 4), ("m3", "fact_deep", 3), ("m4", "fact_deep", 2), ("m5", "fact_deep", 1), ("m6", "fact_deep", 0)]


def test_column_references_are_not_measures(spark, rows):
    measures = spark.createDataFrame([("M", "t", "Sales", "SUM(fact[Base])", None), ("M", "t", "Base", "1", None), ("M", "t", "Ratio", "DIVIDE([Sales], 'dim date'[Base]) + [base]", None)],
                                     "model string, table string, measure string, expression string, format string")
    assert rows(metadata.expression_measures(measures), "measure", "called") == [("Ratio", "Base"), ("Ratio", "Sales")]


def test_filter_kinds(spark, rows):
    flat = spark.createDataFrame([("M", "P", "V", None, '{"filters":[{"displayName":"Only name"}]}', '{"filters":[{"field":{"Column":{"Expression":{"SourceRef":{"Entity":"d"}},"Property":"c"}},"filter":{"Where":[{"Condition":{"Not":1}}]}}]}')],
                                 "model string, page string, visual string, report_filters string, page_filters string, visual_filters string")
    assert rows(metadata.filter_restrictions(flat), "level", "field", "state") == [("page", "Only name", "offered"), ("visual", "d[c]", "condition")]
