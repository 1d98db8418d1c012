"""Checks of captured figures.

Frames (all long, one row per fact, so any number of components is checked in one job):

* ``figures``  component, capture_ord, figure_key, name, value DOUBLE, text, display
* ``captures`` component, capture_ord, label, date_start DATE, date_end DATE, slicers MAP<STRING,STRING>
* ``steps``    component, step_ord, kind, control, member, selected, label (kind ``capture`` ends a group)

``capture_ord`` counts 0, 1, 2, … within a component; 0 is the baseline.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import fixed_values as fixed
from plumbline.functions.relational import attach, shuffled
from plumbline.functions.scalars import format_number, range_relation, typed_equal
from plumbline.operators.running import running_sums

CAPTURE = ["component", "capture_ord"]
POINT = ["component", "capture_ord", "figure_key"]


def check_expectations(observed: DataFrame, expected: DataFrame, by: Sequence[str] = ("capture",)) -> DataFrame:
    """Every expected pointer must be present with the same JSON type and value.

    Both frames hold ``by…, pointer, value`` with ``value`` as JSON text. An empty set of expectations fails the job:
    nothing would have been checked.
    """
    keys = [*by, "pointer"]
    seen = observed.select(*keys, F.col("value").alias("actual"), F.lit(True).alias("present"))
    joined = expected.select(*keys, F.col("value").alias("expected")).join(seen, keys, "left")
    present = F.coalesce("present", F.lit(False))
    status = F.when(present & typed_equal("actual", "expected"), "passed").otherwise("failed")
    out = joined.select(*keys, "expected", "actual", status.alias("status"), F.when(~present, "Missing observation").alias("error"))
    nothing = expected.agg(F.count(F.lit(1)).alias("_n")).where("_n = 0")
    refused = nothing.select(*[F.raise_error(F.lit("no expectations to check")).cast(f.dataType).alias(f.name) for f in out.schema.fields])
    return out.unionByName(refused)


def resolve_expectations(expected: DataFrame, oracles: DataFrame) -> DataFrame:
    """Fill expectations that point at ``(oracle, row, column)``; ``round`` digits are optional.

    ``expected``: …, oracle, row, column, round INT, value DOUBLE; ``oracles``: oracle, row, column, value.
    """
    cells = oracles.select("oracle", "row", "column", F.col("value").cast("double").alias("_oracle_value"))
    joined = expected.join(cells, ["oracle", "row", "column"], "left")
    scale = F.pow(F.lit(10.0), F.col("round"))
    rounded = F.when(F.col("round") == 0, F.bround(F.col("_oracle_value") + F.lit(1e-9), 0)).when(
        F.col("round").isNotNull(), F.bround(F.col("_oracle_value") * scale, 0) / scale).otherwise(F.col("_oracle_value"))
    return joined.withColumn("value", F.when(F.col("oracle").isNotNull(), rounded).otherwise(F.col("value"))).select(*expected.columns)


def receipt_strength(expected: DataFrame, captures: DataFrame, guards: Sequence[str] = fixed.GUARD_POINTERS) -> DataFrame:
    """Is a capture's expectation a receipt? It must assert a value, and after an action a changed one.

    ``expected``: component, capture_ord, pointer, value; ``captures``: component, capture_ord,
    actions BIGINT, allow_weak BOOLEAN, reason STRING.
    """
    values = expected.where(~F.col("pointer").isin(*guards)).select("component", "capture_ord", "pointer", "value")
    before = values.select("component", (F.col("capture_ord") + 1).alias("capture_ord"), "pointer", F.col("value").alias("_before"))
    paired = values.join(before, ["component", "capture_ord", "pointer"], "left")
    same = F.coalesce(F.col("value") == F.col("_before"), F.lit(False))
    counts = paired.groupBy(*CAPTURE).agg(F.count(F.lit(1)).alias("asserted"), F.count_if(same).alias("identical"))
    out = attach(captures, counts, CAPTURE).withColumns({
        "asserted": F.coalesce("asserted", F.lit(0).cast("bigint")), "identical": F.coalesce("identical", F.lit(0).cast("bigint"))})
    waived = F.coalesce("allow_weak", F.lit(False))
    problem = (F.when(waived & (F.trim(F.coalesce("reason", F.lit(""))) == ""), "waiver without a reason").when(waived, None)
               .when(F.col("asserted") == 0, "asserts no value")
               .when((F.col("actions") > 0) & (F.col("identical") == F.col("asserted")), "every asserted value is unchanged after an action"))
    return out.select(*CAPTURE, "asserted", "identical", problem.alias("problem"), F.when(problem.isNull(), "strong").otherwise("weak").alias("strength"))


def evaluate_pairs(figures: DataFrame, pairs: DataFrame) -> DataFrame:
    """Declared comparisons evaluated on every capture.

    ``pairs``: component, label, form (equality, ratio, sum, bound), inputs ARRAY<STRING>, target STRING,
    tolerance DOUBLE, percent BOOLEAN, min DOUBLE, max DOUBLE; ``inputs`` and ``target`` are figure keys.
    A side that is missing, is text or divides by zero gives ``not_comparable`` with a note. The figures of one capture travel
    as one row, so no row is made per figure that a pair reads.
    """
    shape = ["label", "form", "tolerance", "percent", "min", "max", "_n"]
    wanted = F.when(F.col("target").isNull(), F.col("inputs")).otherwise(F.concat("inputs", F.array("target")))
    reads = F.transform(wanted, lambda key, i: F.struct(i.alias("i"), key.alias("key")))
    declared = pairs.withColumns({"_n": F.size("inputs"), "_reads": reads}).where(F.size("_reads") > 0)
    # dealt by component once: grouping and the join find the rows where they are
    declared = declared.repartition("component").groupBy("component", *shape).agg(F.flatten(F.collect_list("_reads")).alias("_reads"))
    number = F.when(~F.isnan("value"), F.col("value"))
    shown = figures.repartition("component").groupBy(*CAPTURE).agg(F.collect_list(F.struct("figure_key", number.alias("number"), "text")).alias("_shown"))
    wide = shown.join(shuffled(declared), "component")
    nothing = F.array(F.struct(F.lit(None).cast("double").alias("number"), F.lit(None).cast("string").alias("text")))

    def cells(read: Column) -> Column:
        """What a capture shows under the key of ``read``; one empty cell if that is nothing."""
        same = F.filter("_shown", lambda f: F.col("capture_ord").isNotNull() & (f["figure_key"] == read["key"]))
        held = F.transform(same, lambda f: F.struct(f["number"], f["text"]))
        return F.transform(F.when(F.size(held) > 0, held).otherwise(nothing), lambda c: F.struct(read["i"].alias("i"), c["number"].alias("number"), c["text"].alias("text")))

    def numbers(test) -> Column:
        return F.transform(F.filter("_cells", lambda c: test(c["i"]) & c["number"].isNotNull()), lambda c: c["number"])
    summed = numbers(lambda i: i < F.col("_n"))
    out = wide.withColumn("_cells", F.flatten(F.transform("_reads", cells))).select(
        *CAPTURE, *shape, F.array_max(numbers(lambda i: i == 0)).alias("first"), F.array_max(numbers(lambda i: i == 1)).alias("second"),
        F.when(F.size(summed) > 0, F.aggregate(summed, F.lit(0.0), lambda total, x: total + x)).alias("parts"),
        F.size(F.filter("_cells", lambda c: (c["i"] < F.col("_n")) & c["number"].isNull())).alias("parts_missing"),
        F.array_max(numbers(lambda i: i == F.col("_n"))).alias("target"),
        F.exists("_cells", lambda c: c["number"].isNull() & c["text"].isNotNull() & (c["text"] != "")).alias("text_only"))
    form = F.col("form")
    factor = F.when(F.coalesce("percent", F.lit(False)), F.lit(100.0)).otherwise(F.lit(1.0))
    limit = F.coalesce("min", "max")
    value_a = (F.when(form == "ratio", F.try_divide("first", F.nullif(F.col("second"), F.lit(0.0))) * factor)
               .when(form == "sum", F.when(F.col("parts_missing") == 0, F.col("parts"))).otherwise(F.col("first")))
    value_b = F.when(form == "equality", F.col("second")).when(form == "bound", limit).otherwise(F.col("target"))
    out = out.withColumns({"value_a": value_a, "value_b": value_b})
    a, b = F.col("value_a"), F.col("value_b")
    within = F.abs(a - b) <= F.abs(F.coalesce("tolerance", F.lit(0.0)))
    inside = F.when(F.col("min").isNotNull(), a >= b).otherwise(a <= b)
    comparable = a.isNotNull() & b.isNotNull()
    status = (F.when(~comparable, "not_comparable").when(F.when(form == "bound", inside).otherwise(within), "consistent")
              .otherwise("inconsistent"))
    zero_divider = (form == "ratio") & F.col("first").isNotNull() & (F.col("second") == 0)
    note = F.when(~comparable, F.when(zero_divider, fixed.NOTE_ZERO_DIVIDER).when(F.coalesce("text_only", F.lit(False)), fixed.NOTE_ABBREVIATED)
                  .otherwise(fixed.NOTE_UNREADABLE))
    return out.select(*CAPTURE, "label", "form", "value_a", "value_b", status.alias("status"), note.alias("note"))


def consistency_equality(figures: DataFrame, a: str, b: str, tolerance: float = 0.0) -> DataFrame:
    return evaluate_pairs(figures, _pair(figures, f"{a} vs {b}", "equality", [a, b], None, tolerance))


def consistency_ratio(figures: DataFrame, num: str, den: str, target: str, tolerance: float = 0.0, percent: bool = False) -> DataFrame:
    return evaluate_pairs(figures, _pair(figures, f"{num} / {den} vs {target}", "ratio", [num, den], target, tolerance, percent))


def consistency_sum(figures: DataFrame, parts: Sequence[str], target: str, tolerance: float = 0.0) -> DataFrame:
    return evaluate_pairs(figures, _pair(figures, f"{' + '.join(parts)} vs {target}", "sum", list(parts), target, tolerance))


def consistency_bound(figures: DataFrame, value: str, minimum: float | None = None, maximum: float | None = None) -> DataFrame:
    """A figure may not cross a limit; the minimum wins when both are given."""
    if minimum is None and maximum is None:
        raise ValueError("give a minimum or a maximum")
    pair = _pair(figures, f"{value} limit", "bound", [value], None, 0.0, False, minimum, None if minimum is not None else maximum)
    return evaluate_pairs(figures, pair)


def _pair(figures, label, form, inputs, target, tolerance, percent=False, minimum=None, maximum=None) -> DataFrame:
    return figures.select("component").distinct().select(
        "component", F.lit(label).alias("label"), F.lit(form).alias("form"), F.array(*[F.lit(i) for i in inputs]).alias("inputs"),
        F.lit(target).cast("string").alias("target"), F.lit(float(tolerance)).alias("tolerance"), F.lit(percent).alias("percent"),
        F.lit(minimum).cast("double").alias("min"), F.lit(maximum).cast("double").alias("max"))


def consistency_status(results: DataFrame) -> DataFrame:
    """Pairs per status and reason."""
    return results.groupBy("label", "status", "note").agg(F.count(F.lit(1)).alias("captures"))


def _with_baseline(figures: DataFrame) -> DataFrame:
    base = figures.where("capture_ord = 0").select("component", "figure_key", F.col("value").alias("base_value"), F.col("display").alias("base_display"))
    return figures.join(shuffled(base), ["component", "figure_key"], "left")


def _with_previous(figures: DataFrame) -> DataFrame:
    before = figures.select("component", (F.col("capture_ord") + 1).alias("capture_ord"), "figure_key",
                            F.col("value").alias("prev_value"), F.col("display").alias("prev_display"), F.lit(True).alias("had"))
    return figures.join(shuffled(before), POINT, "inner")


def delta(figures: DataFrame) -> DataFrame:
    """Change against the baseline capture, with the rounded percentage; only where both are numbers and differ."""
    joined = _with_baseline(figures).where("capture_ord > 0")
    change = F.col("value") - F.col("base_value")
    percent = F.when(F.col("base_value") != 0, F.abs(F.bround(change / F.col("base_value") * 100, 0)).cast("bigint"))
    sign = F.when(change < 0, "−").otherwise("+")
    text = F.concat(sign, format_number(F.abs(change)), F.when(percent.isNotNull(), F.concat(F.lit(" ("), sign, percent.cast("string"), F.lit("%)"))).otherwise(""))
    return joined.where(F.col("value") != F.col("base_value")).select(*POINT, "value", "base_value", change.alias("change"), percent.alias("percent"), text.alias("text"))


def context_key(date_start: Column | str = "date_start", date_end: Column | str = "date_end", slicers: Column | str = "slicers") -> Column:
    """Canonical text of a capture's filter context: dates and slicer captions, order-free."""
    pairs = F.array_sort(F.map_entries(slicers))
    return F.to_json(F.struct(F.coalesce(F.col(date_start).cast("string"), F.lit("")).alias("s"), F.coalesce(F.col(date_end).cast("string"), F.lit("")).alias("e"), pairs.alias("f")))


def changed_filters(captures: DataFrame) -> DataFrame:
    """Slicer captions that differ from the baseline capture, as sorted text; the baseline lists its own selections."""
    base = captures.where("capture_ord = 0").select("component", F.col("slicers").alias("_base"))
    joined = captures.join(shuffled(base), "component", "left")
    differing = F.map_filter("slicers", lambda k, v: ~v.eqNullSafe(F.try_element_at("_base", k)))
    text = F.array_join(F.transform(F.array_sort(F.map_entries(differing)), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))), ", ")
    own = F.filter(F.array_sort(F.map_entries("slicers")), lambda e: ~F.lower(F.trim(F.coalesce(e["value"], F.lit("")))).isin("", "all", "all values"))
    chosen = F.array_join(F.transform(own, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", ")
    listed = F.when(F.coalesce(F.size("slicers"), F.lit(0)) == 0, "as captured").when(chosen == "", "all values selected").otherwise(chosen)
    shown = F.when((F.col("capture_ord") == 0) | F.col("_base").isNull(), listed).when(text == "", "as baseline").otherwise(text)
    return joined.select(*CAPTURE, shown.alias("changed_filters"), context_key().alias("context"))


def reset_differences(captures: DataFrame, figures: DataFrame, restored: DataFrame | None = None) -> DataFrame:
    """The figures behind a failed reset: component, capture_ord, figure_key, what the baseline showed and what is shown."""
    failed = reset_check(captures, figures, restored).where("status = 'fail'").select(*CAPTURE)
    rows = _with_baseline(figures).where(F.col("base_display").isNotNull() & (F.col("display") != F.col("base_display")))
    return rows.join(failed, CAPTURE, "left_semi").select(*POINT, "base_display", "display")


def reset_check(captures: DataFrame, figures: DataFrame, restored: DataFrame | None = None) -> DataFrame:
    """Captures back on the baseline's dates and slicers must show the baseline's figures again.

    ``restored`` (component, capture_ord, restored) keeps captures out whose controls are not back.
    """
    contexts = captures.select(*CAPTURE, context_key().alias("context"))
    base = contexts.where("capture_ord = 0").select("component", F.col("context").alias("_base"))
    back = contexts.where("capture_ord > 0").join(shuffled(base), "component").where("context = _base").select(*CAPTURE)
    if restored is not None:
        back = attach(back, shuffled(restored.select(*CAPTURE, "restored")), CAPTURE).where("restored is null or restored").drop("restored")
    differs = F.col("base_display").isNotNull() & (F.col("display") != F.col("base_display"))
    counts = _with_baseline(figures).groupBy(*CAPTURE).agg(F.count_if(differs).alias("differing"))
    out = attach(back, shuffled(counts), CAPTURE).withColumn("differing", F.coalesce("differing", F.lit(0).cast("bigint")))
    return out.withColumn("status", F.when(F.col("differing") > 0, "fail").otherwise("pass"))


def changed_check(figures: DataFrame, actions: DataFrame) -> DataFrame:
    """After an action at least one figure must move. ``actions``: component, capture_ord, actions."""
    moved = _with_previous(figures).groupBy(*CAPTURE).agg(F.count_if(F.col("display") != F.col("prev_display")).alias("moved"))
    acted = actions.where("capture_ord > 0 and actions > 0").select(*CAPTURE, "actions")
    out = attach(acted, shuffled(moved), CAPTURE).withColumn("moved", F.coalesce("moved", F.lit(0).cast("bigint")))
    return out.withColumn("status", F.when(F.col("moved") > 0, "pass").otherwise("fail"))


def direction_check(figures: DataFrame, captures: DataFrame, actions: DataFrame) -> DataFrame:
    """Narrowing may not raise a figure, widening may not lower one; only after a single action.

    ``actions``: component, capture_ord, actions BIGINT, kind STRING, selected BOOLEAN of the single action.
    """
    before = captures.select("component", (F.col("capture_ord") + 1).alias("capture_ord"), F.col("date_start").alias("_ps"), F.col("date_end").alias("_pe"))
    spans = captures.select(*CAPTURE, "date_start", "date_end").join(shuffled(before), CAPTURE)
    joined = spans.join(shuffled(actions.where("actions = 1")), CAPTURE)
    relation = range_relation("_ps", "_pe", "date_start", "date_end")
    expectation = (F.when(F.col("kind") == "toggle_member", F.when(F.col("selected"), "not_down").otherwise("not_up"))
                   .when((F.col("kind") == "set_date") & (relation == "narrowed"), "not_up")
                   .when((F.col("kind") == "set_date") & (relation == "widened"), "not_down"))
    judged = joined.select(*CAPTURE, expectation.alias("expectation")).where("expectation is not null")
    pairs = _with_previous(figures).select(*CAPTURE, "value", "prev_value")
    scored = attach(judged, shuffled(pairs), CAPTURE)
    wrong = F.when(F.col("expectation") == "not_up", F.col("value") > F.col("prev_value")).otherwise(F.col("value") < F.col("prev_value"))
    out = scored.groupBy(*CAPTURE, "expectation").agg(F.count_if(wrong).alias("wrong"))
    return out.withColumn("status", F.when(F.col("wrong") > 0, "fail").otherwise("pass"))


def consistency_failures(results: DataFrame, by: Sequence[str] = ("component",)) -> DataFrame:
    """The captures behind a failing pair, one row each."""
    return results.where("status = 'inconsistent'").select(*by, "label", *[c for c in ("capture_ord", "note") if c in results.columns])


def consistency_rollup(results: DataFrame, by: Sequence[str] = ("component",)) -> DataFrame:
    """One row per pair: fail if any capture disagrees, pass if any compares, else unknown."""
    out = results.groupBy(*by, "label").agg(
        F.count_if(F.col("status") == "inconsistent").alias("failing"), F.count_if(F.col("status") == "consistent").alias("holding"),
        F.min("note").alias("note"))
    status = F.when(F.col("failing") > 0, "fail").when(F.col("holding") > 0, "pass").otherwise("unknown")
    return out.withColumn("status", status).withColumn("note", F.when(status == "unknown", F.coalesce("note", F.lit("one of the figures was not readable"))))


def receipt_rollup(receipts: DataFrame, by: Sequence[str] = ("component",)) -> DataFrame:
    """All receipts of a component passed, or not; components without a receipt give no row."""
    done = receipts.where(F.col("status").isNotNull() & (F.col("status") != ""))
    return done.groupBy(*by).agg(F.when(F.bool_and(F.col("status") == "passed"), "pass").otherwise("fail").alias("status"), F.count(F.lit(1)).alias("receipts"))


def _named(figures: DataFrame, captures: DataFrame) -> DataFrame:
    contexts = captures.select(*CAPTURE, context_key().alias("context"))
    return figures.where(F.trim("name") != "").select(*CAPTURE, F.lower(F.trim("name")).alias("name"), "value", "display").join(contexts, CAPTURE)


def cross_component(figures: DataFrame, captures: DataFrame) -> DataFrame:
    """A figure name shown by two or more components under the same filter context must agree."""
    picked = _named(figures, captures).groupBy("name", "context", "component").agg(
        F.min_by("display", F.struct("capture_ord", "display")).alias("display"))
    out = picked.groupBy("name", "context").agg(
        F.count(F.lit(1)).alias("components"), F.min("display").alias("lowest"), F.max("display").alias("highest"))
    out = out.where("components >= 2")
    return out.withColumn("status", F.when(F.col("lowest") == F.col("highest"), "pass").otherwise("fail"))


def shared_without_match(figures: DataFrame, captures: DataFrame, limit: int = 12) -> DataFrame:
    """Same name on two or more components but never under one context: listed, not judged (first 12)."""
    named = _named(figures, captures).groupBy("name", "context", "component").agg(
        F.min(F.struct("capture_ord", "display")).alias("first"))
    compared = named.groupBy("name", "context").agg(F.count(F.lit(1)).alias("_c")).where("_c >= 2").select("name", "context")
    leftover = named.join(compared, ["name", "context"], "left_anti")
    several = leftover.select("name", "component").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("_c")).where("_c >= 2").select("name")
    rows = leftover.join(several, "name", "left_semi")
    order = Window.partitionBy("name").orderBy("component", "first.capture_ord", "context")
    return rows.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit).select(
        "name", "position", "component", F.col("first.capture_ord").alias("capture_ord"), "context", F.col("first.display").alias("display"))


def _since_baseline(steps: DataFrame) -> DataFrame:
    """Steps with the number of captures before them."""
    capture = (F.col("kind") == "capture").cast("bigint")
    placed = running_sums(steps, ["component"], "step_ord", {"_seen": capture})
    return placed.withColumn("captures_before", F.col("_seen") - capture).drop("_seen")


def actions_between(steps: DataFrame) -> DataFrame:
    """Every action with the capture that follows it (capture_ord); actions after the last capture are dropped."""
    placed = _since_baseline(steps)
    captures = placed.where("kind = 'capture'").select("component", "captures_before", F.col("label").alias("capture_label"))
    return placed.where("kind != 'capture'").drop("label").join(shuffled(captures), ["component", "captures_before"]).withColumnRenamed("captures_before", "capture_ord")


def restored_captures(steps: DataFrame) -> DataFrame:
    """Is every control touched since the baseline back where it started, at each capture?

    Each step is turned into +1 or -1 controls away from the start; a capture is restored when the
    running sum is zero. A member is away while its selection differs from the one before its first
    toggle; an option or a clicked mark is away after an odd number of steps.
    """
    placed = _since_baseline(steps)
    # nothing before the first capture counts as a change
    moves = placed.where("captures_before > 0 and kind in ('toggle_member', 'select_option', 'click_mark')").withColumn(
        "member", F.when(F.col("kind") != "select_option", F.coalesce("member", F.lit("")))
        .otherwise(F.lit(""))).withColumn("control", F.coalesce("control", F.lit("")))
    control = ["component", "kind", "control", "member"]
    counted = running_sums(moves, control, "step_ord", {"_nth": F.lit(1).cast("bigint")}, {"_last": "selected"})
    start = moves.groupBy(*control).agg(F.min_by(~F.coalesce("selected", F.lit(False)), "step_ord").alias("_initial"))
    counted = attach(counted, shuffled(start), control)
    toggled = F.coalesce("selected", F.lit(False)) != F.col("_initial")
    was = F.when(F.col("_nth") > 1, F.coalesce("_last", F.lit(False)) != F.col("_initial")).otherwise(F.lit(False))
    by_parity = F.when(F.col("_nth") % 2 == 1, 1).otherwise(-1)
    change = F.when(F.col("kind") == "toggle_member", toggled.cast("int") - was.cast("int")).otherwise(by_parity)
    changes = counted.select("component", "step_ord", change.cast("bigint").alias("_away"))
    marks = placed.where("kind = 'capture'").select("component", "step_ord", F.lit(0).cast("bigint").alias("_away"), "label", F.col("captures_before").alias("capture_ord"))
    line = running_sums(changes.unionByName(marks, allowMissingColumns=True), ["component"], "step_ord", {"_off": F.col("_away")})
    return line.where("capture_ord is not null").select("component", "capture_ord", "label", (F.col("_off") == 0).alias("restored"))


def observed_table(captures: DataFrame, figures: DataFrame, keys: Sequence[str], restored: DataFrame | None = None) -> DataFrame:
    """One row per capture: dates, changed filters, each figure and its change against the baseline."""
    shown = _with_baseline(figures).where(F.col("figure_key").isin(*keys)).withColumn(
        "change", F.when(F.col("capture_ord") > 0, F.col("value") - F.col("base_value")))
    wide = shown.groupBy(*CAPTURE).pivot("figure_key", list(keys)).agg(F.first("value", ignorenulls=True).alias("value"), F.first("change", ignorenulls=True).alias("change"))
    out = captures.select(*CAPTURE, "label", "date_start", "date_end")
    out = attach(attach(out, shuffled(changed_filters(captures).drop("context")), CAPTURE), shuffled(wide), CAPTURE)
    status = reset_check(captures, figures, restored).select(*CAPTURE, F.when(F.col("status") == "pass", "Back to baseline").otherwise("Differs from baseline").alias("back_to_baseline"))
    return attach(out, shuffled(status), CAPTURE)
