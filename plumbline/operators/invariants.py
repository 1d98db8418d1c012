"""Invariant probes: counts that should be zero, grain and join checks, completeness checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.relational import attach, keyed, unkeyed

COMPARE = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}


def assert_value(
    df: DataFrame, column: str, op: str = "==", value: float = 0, tolerance: float | None = None, blank_as_zero: bool = True,
    row: int = 0, order: Sequence[str] = (), counts: bool = False,
) -> DataFrame:
    """One value of a result against an expectation: ``passed`` or ``failed``.

    The tolerance applies to ``==`` only. ``row`` other than 0 needs an explicit ``order``.
    ``counts=True`` says the value is a count, and an expectation that no count can break is refused.
    """
    if op not in COMPARE:
        raise ValueError(f"unknown operator {op}; use one of {list(COMPARE)}")
    if (row or order) and not order:
        raise ValueError("a row position needs an order")
    if counts and ((op == ">=" and value <= 0) or (op == ">" and value < 0)):
        raise ValueError(f"a count is always {op} {value}; this expectation can never fail")
    picked = df.orderBy(*order).offset(row).limit(1) if order else df
    actual = F.max(F.col(column).cast("double"))
    if blank_as_zero:
        actual = F.coalesce(actual, F.lit(0.0))
    wanted = F.lit(float(value))
    seen = F.col("actual")
    holds = F.abs(seen - wanted) <= float(tolerance) if tolerance is not None and op == "==" else COMPARE[op](seen, wanted)
    out = picked.agg(F.count(F.lit(1)).alias("_rows"), actual.alias("actual"))
    return out.select(
        F.lit("dax.assert").alias("method"),
        F.when(F.col("_rows") == 0, "inconclusive").when(F.coalesce(holds, F.lit(False)), "passed").otherwise("failed").alias("status"),
        F.when(F.col("_rows") > 0, seen).alias("actual"), F.lit(op).alias("operator"), wanted.alias("expected"),
        F.lit(tolerance).cast("double").alias("tolerance"))


def _with_window(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, start: str, end: str | None) -> DataFrame:
    ends = [F.col(end).cast("date").alias("_end")] if end else [F.lit(None).cast("date").alias("_end")]
    windows = dim.select(F.col(dim_key).alias("_dim_key"), F.col(start).cast("date").alias("_start"), *ends)
    return fact.join(windows, fact[fact_key] == F.col("_dim_key"), "left")


def window_alignment(
    fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, date: str, start: str, end: str, open_end: str = "never_outside",
) -> DataFrame:
    """Fact rows dated outside their dimension window (one row per fact row that is outside).

    ``open_end`` says what a missing end date means: ``never_outside`` or ``outside``.
    """
    if open_end not in ("never_outside", "outside"):
        raise ValueError("open_end is never_outside or outside")
    joined = _with_window(fact, dim, fact_key, dim_key, start, end)
    day = F.col(date).cast("date")
    late = day > F.col("_end")
    if open_end == "outside":
        late = late | F.col("_end").isNull()
    outside = F.col("_start").isNotNull() & F.coalesce((day < F.col("_start")) | late, F.lit(False))
    return joined.where(outside).select(*fact.columns, F.col("_start").alias("window_start"), F.col("_end").alias("window_end"))


def undated_events(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, start: str) -> DataFrame:
    """Fact rows that carry a key whose dimension row has no start date (or does not exist)."""
    joined = _with_window(fact, dim, fact_key, dim_key, start, None)
    return joined.where(F.col(fact_key).isNotNull() & F.col("_start").isNull()).select(*fact.columns)


def name_churn(df: DataFrame, key: str, name: str) -> DataFrame:
    """Keys that carry more than one name; a missing name counts as one."""
    pairs = df.groupBy(key, name).agg(F.count(F.lit(1)).alias("_c"))
    return pairs.groupBy(key).agg(F.count(F.lit(1)).alias("names"), F.sum("_c").alias("rows")).where("names > 1")


def member_set_diff(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Distinct members of two sets with the side(s) they occur on; one shuffle, null is a member."""
    tagged = a.select(F.col(column).alias("member"), F.lit(True).alias("_a")).unionByName(
        b.select(F.col(column).alias("member"), F.lit(False).alias("_a")))
    return tagged.groupBy("member").agg(F.bool_or("_a").alias("in_a"), F.bool_or(~F.col("_a")).alias("in_b"))


def day_boundary(
    df: DataFrame, ts: str, date_key: str, offset_hours: float = 0, tz: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Rows whose date key is not the calendar date of their (shifted) timestamp.

    ``tz`` converts UTC to a named zone with its daylight saving rules; otherwise a fixed offset applies.
    """
    rows, groups = keyed(df, by)
    stamp = F.col(ts).cast("timestamp_ntz")
    if tz:
        local = F.convert_timezone(F.lit("UTC"), F.lit(tz), stamp)
    else:
        local = stamp + F.make_dt_interval(secs=F.lit(float(offset_hours) * 3600))
    wrong = stamp.isNotNull() & F.coalesce(local.cast("date") != F.col(date_key).cast("date"), F.lit(True))
    return unkeyed(rows.groupBy(*groups).agg(F.count_if(wrong).alias("mismatched"), F.count(F.lit(1)).alias("rows")))


def negative_durations(df: DataFrame, duration: Column | str, by: Sequence[str] = ()) -> DataFrame:
    rows, groups = keyed(df, by)
    length = F.col(duration) if isinstance(duration, str) else duration
    return unkeyed(rows.groupBy(*groups).agg(F.count_if(length < 0).alias("negative"), F.count(F.lit(1)).alias("rows")))


def after_watermark(df: DataFrame, date: str, watermark, by: Sequence[str] = ()) -> DataFrame:
    """Rows dated after the load watermark: a date, or a one-row frame whose first column is the date."""
    rows, groups = keyed(df, by)
    if isinstance(watermark, DataFrame):
        mark = watermark.agg(F.max(watermark.columns[0]).cast("date")).scalar()
    else:
        mark = F.lit(watermark).cast("date")
    late = F.col(date).cast("date") > mark
    return unkeyed(rows.groupBy(*groups).agg(F.count_if(late).alias("after_watermark"), F.count(F.lit(1)).alias("rows")))


def orphan_keys(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str) -> DataFrame:
    """Keys present on one side only, with their row counts; keys are counted before they meet."""
    tagged = fact.select(F.col(fact_key).alias("key"), F.lit(1).alias("_f")).unionByName(
        dim.select(F.col(dim_key).alias("key"), F.lit(0).alias("_f")))
    sides = tagged.where(F.col("key").isNotNull()).groupBy("key").agg(
        F.count_if(F.col("_f") == 1).alias("fact_rows"), F.count_if(F.col("_f") == 0).alias("dim_rows"))
    side = F.when(F.col("dim_rows") == 0, "fact_without_dim").when(F.col("fact_rows") == 0, "dim_without_fact")
    return sides.withColumn("side", side).where("side is not null").select("side", "key", "fact_rows", "dim_rows")


def zero_denominator(df: DataFrame, by: Sequence[str], den: str, expected: DataFrame | None = None) -> DataFrame:
    """Periods whose denominator is zero, blank, or (given the ``expected`` periods) absent."""
    sums = df.groupBy(*by).agg(F.sum(den).cast("double").alias("denominator"), F.count(F.lit(1)).alias("rows"))
    if expected is not None:
        sums = attach(expected.select(*by).distinct(), sums, by)
    state = F.when(F.col("rows").isNull(), "absent").when(F.col("denominator").isNull(), "null").when(F.col("denominator") == 0, "zero")
    return sums.withColumn("state", state).where("state is not null").select(*by, "state", F.coalesce("rows", F.lit(0).cast("bigint")).alias("rows"))


def flagged_complete_periods(calendar: DataFrame, fact: DataFrame, month: str, complete: str, date: str) -> DataFrame:
    """Months marked complete whose data does not reach their last day."""
    reached = fact.groupBy(F.trunc(F.col(date).cast("date"), "month").alias("_month")).agg(F.max(F.col(date).cast("date")).alias("last_data"))
    marked = calendar.where(F.col(complete)).select(F.trunc(F.col(month).cast("date"), "month").alias("month")).distinct()
    joined = marked.join(reached, F.col("month") == F.col("_month"), "left").withColumn("last_day", F.last_day("month"))
    return joined.where(F.coalesce(F.col("last_data") < F.col("last_day"), F.lit(True))).select("month", "last_day", "last_data")


def empty_days(fact: DataFrame, date: str, start=None, end=None) -> DataFrame:
    """Calendar days of the range without any row; the range defaults to the data's own span."""
    days = fact.select(F.col(date).cast("date").alias("day")).where("day is not null").distinct()
    span = days.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    first = F.lit(start).cast("date") if start is not None else F.col("a")
    last = F.lit(end).cast("date") if end is not None else F.col("b")
    calendar = span.select(F.explode(F.when(last >= first, F.sequence(first, last))).alias("day"))
    return calendar.join(days, "day", "left_anti")


def partial_period_share(
    df: DataFrame, by: Sequence[str], date: str, value: str, start, end, whole_start, whole_end, reported: DataFrame | None = None,
    reported_value: str = "reported", tolerance: float = 0.5,
) -> DataFrame:
    """Amount inside a partial range against the whole period, and which of them a report shows."""
    rows, groups = keyed(df, by)
    day, amount = F.col(date).cast("date"), F.col(value)
    rows = rows.where(day.between(F.lit(whole_start).cast("date"), F.lit(whole_end).cast("date")))
    inside = day.between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    out = rows.groupBy(*groups).agg(
        F.coalesce(F.sum(F.when(inside, amount)), F.lit(0)).cast("double").alias("partial_amount"), F.sum(amount).cast("double").alias("whole_amount"))
    out = out.withColumn("share", F.try_divide("partial_amount", F.nullif(F.col("whole_amount"), F.lit(0.0))))
    if reported is not None:
        shown, _ = keyed(reported, by)
        out = attach(out, shown.select(*groups, F.col(reported_value).cast("double").alias("reported")), groups)
        partial = F.abs(F.col("reported") - F.col("partial_amount")) <= tolerance
        whole = F.abs(F.col("reported") - F.col("whole_amount")) <= tolerance
        out = out.withColumn("shows", F.when(F.col("reported").isNull(), "missing").when(partial, "partial").when(whole, "whole").otherwise("neither"))
    return unkeyed(out)


def latest_version(df: DataFrame, key: Sequence[str], version: Sequence[str], as_of=None, as_of_column: str | None = None,
                   eligible: Column | None = None) -> DataFrame:
    """Newest row per key at an as-of bound. Eligibility is applied after the newest row is chosen.

    ``max_by`` keeps one row per key in the map-side combine, so a hot key is reduced before the shuffle.
    """
    known = df if as_of is None else df.where(F.col(as_of_column or version[0]) <= as_of)
    rest = [c for c in df.columns if c not in key]
    newest = known.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("_row")).select(*key, "_row.*")
    newest = newest.select(*df.columns)
    return newest if eligible is None else newest.where(eligible)


def grain_check(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, distinct keys, surplus rows and the worst multiplicity of a composite key."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    out = counts.agg(
        F.coalesce(F.sum("_c"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct_keys"),
        F.count_if(F.col("_c") > 1).alias("repeated_keys"), F.coalesce(F.max("_c"), F.lit(0)).alias("worst"))
    return out.withColumn("duplicate_rows", F.col("rows") - F.col("distinct_keys")).withColumn(
        "status", F.when(F.col("duplicate_rows") > 0, "flagged").otherwise("clean"))


def join_amount_check(
    base: DataFrame, path: DataFrame, base_key: Sequence[str], path_key: Sequence[str], measures: Sequence[str], how: str = "left",
) -> DataFrame:
    """Row count and additive totals of ``base`` before and after joining ``path``.

    Both sides are aggregated per key, so the joined totals are products of counts and the join
    itself never runs.
    """
    left = base.groupBy(*base_key).agg(
        F.count(F.lit(1)).cast("decimal(20,0)").alias("rows"), *[F.sum(F.col(m)).alias(m) for m in measures])
    right = path.groupBy(*path_key).agg(F.count(F.lit(1)).alias("_r")).withColumnsRenamed({k: f"_r_{k}" for k in path_key})
    condition = reduce(lambda a, b: a & b, [F.col(a) == F.col(f"_r_{b}") for a, b in zip(base_key, path_key)])
    copies = F.coalesce(F.col("_r"), F.lit(1 if how == "left" else 0).cast("bigint"))
    names = ["rows", *measures]
    totals = left.join(right, condition, "left").agg(
        *[F.sum(m).cast("double").alias(f"b_{m}") for m in names],
        *[F.sum(F.col(m) * copies).cast("double").alias(f"a_{m}") for m in names])
    table = F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(f"b_{m}").alias("before"), F.col(f"a_{m}").alias("after")) for m in names]))
    out = totals.select(table.alias("t")).select("t.*")
    return out.withColumn("delta", F.col("after") - F.col("before")).withColumn(
        "status", F.when(F.col("delta") == 0, "clean").otherwise("flagged"))


def overlap_check(df: DataFrame, key: str, segment: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct keys in total against the sum of the segments' distinct keys."""
    rows, groups = keyed(df, by)
    pairs = rows.select(*groups, key, segment).distinct()
    per_key = pairs.groupBy(*groups, key).agg(F.count(F.lit(1)).alias("_s"))
    out = per_key.groupBy(*groups).agg(
        F.count(key).alias("distinct_total"), F.sum(F.when(F.col(key).isNotNull(), F.col("_s"))).alias("segment_sum"),
        F.count_if((F.col("_s") > 1) & F.col(key).isNotNull()).alias("shared_keys"))
    return unkeyed(out.withColumn("overlap", F.col("segment_sum") - F.col("distinct_total")))


def segment_reconcile(source: DataFrame, model: DataFrame, segment: Sequence[str], amount: str, tolerance: float = 0.005) -> DataFrame:
    """Counts and amounts of two populations by disjoint segment, matched in one shuffle."""
    both = source.select(*segment, F.col(amount).alias("_v"), F.lit(0).alias("_m")).unionByName(
        model.select(*segment, F.col(amount).alias("_v"), F.lit(1).alias("_m")))
    first, second = F.col("_m") == 0, F.col("_m") == 1
    zero = F.lit(0)
    out = both.groupBy(*segment).agg(
        F.count_if(first).alias("source_rows"), F.count_if(second).alias("model_rows"),
        F.coalesce(F.sum(F.when(first, F.col("_v"))), zero).cast("double").alias("source_amount"),
        F.coalesce(F.sum(F.when(second, F.col("_v"))), zero).cast("double").alias("model_amount"))
    out = out.withColumns({"row_delta": F.col("model_rows") - F.col("source_rows"), "amount_delta": F.col("model_amount") - F.col("source_amount")})
    same = (F.col("row_delta") == 0) & (F.abs("amount_delta") <= tolerance)
    return out.withColumn("status", F.when(same, "equal").otherwise("different"))


def top_offenders(violations: DataFrame, key: Sequence[str], k: int = 10, population: DataFrame | None = None) -> DataFrame:
    """The k keys with most violations, with their share of all violations (and of the population)."""
    counts = violations.groupBy(*key).agg(F.count(F.lit(1)).alias("violations"))
    total = counts.agg(F.sum("violations")).scalar()
    top = counts.orderBy(F.desc("violations"), *key).limit(k)
    out = top.withColumn("share", F.col("violations") / total)
    if population is not None:
        out = out.withColumn("population_share", F.try_divide("violations", population.agg(F.count(F.lit(1))).scalar()))
    return out


def subtotal_shape(df: DataFrame, dims: Sequence[str], measure: str, shape: str = "rollup") -> DataFrame:
    """Leaf rows, subtotals and grand total with their own grain number (0 = leaf)."""
    grouped = df.rollup(*dims) if shape == "rollup" else df.cube(*dims)
    return grouped.agg(F.grouping_id().alias("grain"), F.count(F.lit(1)).alias("rows"), F.sum(measure).cast("double").alias("amount"))
