"""Similar names against a plain comparison of everything with everything; calls followed to their end."""

import random
from difflib import SequenceMatcher

import pytest

from plumbline.operators import metadata, names


def best(name, known, top):
    low = {}
    for c in sorted(k for k in known if k is not None and not k.upper().startswith("ROWNUMBER-")):
        low.setdefault(c.lower(), c)
    scored = sorted(((SequenceMatcher(None, c, name.lower()).ratio(), c) for c in low), reverse=True)
    return [low[c] for r, c in scored if r >= 0.6][:top]


def test_finds_what_a_full_comparison_finds(spark):
    dice = random.Random(5)
    known = {"".join(dice.choice("abcdefg_") for _ in range(dice.randint(1, 16))) for _ in range(150)} | {"Sales Amount", "sales amounts", "a", "ab", "RowNumber-1", "axbxc"}
    asked = {"Sales Amuont", "A", "b", "axb", "abc", "", "salesamount", "rownumber-1"}
    for k in sorted(known)[:60]:
        text = list(k)
        for _ in range(dice.randint(1, 3)):
            text.insert(dice.randrange(len(text) + 1), dice.choice("xyz"))
        asked.add("".join(text))
    wanted = spark.createDataFrame([("m", a) for a in sorted(asked)] + [("m", None), ("other", "ab")], "model string, name string")
    candidates = spark.createDataFrame([("m", k) for k in sorted(known)] + [("m", None), ("third", "ab")], "model string, candidate string")
    for top in (1, 3):
        found = {}
        for r in names.similar_names(wanted, candidates, ["model"], "name", top).orderBy("rank").collect():
            assert r["model"] == "m"
            found.setdefault(r["name"], []).append(r["closest"])
        for a in asked:
            assert found.get(a.lower(), []) == best(a, known, top), a


def test_name_search_keeps_its_plan_small_and_off_the_driver(spark):
    """One plan over everything that the references were made from had 800,000 characters; broadcast names filled the driver."""
    columns = spark.createDataFrame([("m", "fact_sales", "amount"), ("m", "dim_date", "day")], 'model string, `table` string, `column` string')
    measures = spark.createDataFrame([("m", f"Measure {i}") for i in range(30)], "model string, measure string")
    queries = spark.createDataFrame([("m", "q", "EVALUATE ROW(SUM(fact_sale[amount]), [Measure 31], fact_sales[amout])")], "model string, query_id string, text string")
    errors = spark.createDataFrame([("m", "e", "Column 'amout' cannot be found; see 'fact_sales'.")], "model string, error_id string, message string")
    checked, told = metadata.check_references(queries, columns, measures), metadata.suggest_from_error(errors, columns, measures)
    for frame in (checked, told):
        plan = frame._jdf.queryExecution().sparkPlan().toString()
        assert len(plan) < 60_000 and "Broadcast" not in plan
    assert {(r["kind"], r["name"], r["closest"]) for r in checked.collect()} == {("table", "fact_sale", "fact_sales"), ("column", "amout", "amount"), ("measure", "Measure 31", "Measure 3")}
    assert [r["names"] for r in told.collect()] == [["amount"]]


def test_null_scopes_and_a_low_cutoff(spark):
    one = spark.createDataFrame([(None, "amout"), ("t", "amout")], "t string, name string")
    two = spark.createDataFrame([(None, "amount")], "t string, candidate string")
    assert [(r["t"], r["closest"]) for r in names.similar_names(one, two, ["t"]).collect()] == [(None, "amount")]
    assert metadata.closest_name(one, two, ["t"], "name").where("closest is null").count() == 1
    with pytest.raises(ValueError):
        names.similar_names(one, two, ["t"], cutoff=0.4)


def test_a_measure_may_be_meant_as_a_column(spark):
    queries = spark.createDataFrame([("m", "q", "EVALUATE FILTER(sales, sales[price] > [amout])")], "model string, query_id string, text string")
    columns = spark.createDataFrame([("m", "sales", "price"), ("m", "sales", "amount"), ("m", "RowNumber-7", "x")], 'model string, "table" string, column string'.replace('"', "`"))
    measures = spark.createDataFrame([("m", "Total")], "model string, measure string")
    assert [(r["kind"], r["name"], r["closest"]) for r in metadata.check_references(queries, columns, measures).collect()] == [("measure", "amout", "amount")]


def test_error_text(spark):
    columns = spark.createDataFrame([("m", "sales", "amount"), ("m", "dates", "day")], "model string, `table` string, column string")
    measures = spark.createDataFrame([("m", "Total Sales"), ("m", "Total Sale")], "model string, measure string")
    errors = spark.createDataFrame([("m", 1, "no 'Total Salez' and \"sales\" nor 'zzzz'"), ("m", 2, None), ("none", 3, "'amout'")], "model string, error_id int, message string")
    found = metadata.suggest_from_error(errors, columns, measures).collect()
    assert [(r["error_id"], r["note"]) for r in found] == [(1, "Engine mentioned 'Total Salez'; closest model names: Total Sale, Total Sales")]


def measures_of(spark, calls):
    return spark.createDataFrame([("m", n, e) for n, e in calls.items()], "model string, measure string, expression string")


def test_calls_to_the_end(spark):
    chain = {f"L{i}": f"[L{i + 1}]" for i in range(10)} | {"L10": "COUNTROWS(deep)", "A": "[B]", "B": "[A] + SUM(near[x])", "Own": "[Own]", "Far": "[A]", "None": None}
    x = measures_of(spark, chain)
    tables = spark.createDataFrame([("m", "deep"), ("m", "near")], "model string, `table` string")
    edges = metadata.expression_measures(x)
    closure = {(r["measure"], r["table"]): r["level"] for r in metadata.measure_closure(x, tables).collect()}
    assert closure["L0", "deep"] == 10 and closure["A", "near"] == 1 and closure["Far", "near"] == 2 and ("Own", "near") not in closure
    flags = {r["measure"]: (r["reached"], r["levels"], r["cyclic"], r["cut"]) for r in metadata.reach_flags(metadata.called_measures(edges, x), edges).collect()}
    assert flags["L0"] == (10, 10, False, False) and flags["A"] == (1, 1, True, False) and flags["Own"] == (0, 0, True, False) and flags["Far"] == (2, 2, False, False) and flags["None"] == (0, 0, False, False)
    cut = {r["measure"]: (r["levels"], r["cut"]) for r in metadata.reach_flags(metadata.called_measures(edges, x, depth=4), edges).collect()}
    assert cut["L0"] == (4, True) and cut["L6"] == (4, False) and cut["A"] == (1, False)
    assert metadata.measure_closure(x, tables, depth=4).where("measure = 'L0'").count() == 0


def test_guarded_divisions(spark):
    rows = [("two", "DIVIDE([a], SUM(t[x]))"), ("three", "DIVIDE(MAX(t[x], 1), [b], 0)"), ("nested", "DIVIDE(DIVIDE([a], [b]), [c], BLANK())"), ("text", '"DIVIDE(a)" & "x"'),
            ("comment", "1 // DIVIDE(a, b)"), ("caller", "[two]"), ("other", "MYDIVIDE(a)"), ("open", "DIVIDE([a], ("), ("none", None)]
    found = {(r["measure"], r["level"]) for r in metadata.expression_chips(measures_of(spark, dict(rows))).collect()}
    assert found == {("two", 0), ("nested", 0), ("caller", 1)}
