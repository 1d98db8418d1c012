"""Statistics over many series at once; ``by`` names the columns that identify a series."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from plumbline.functions import fixed_values as fixed
from plumbline.functions.relational import attach, check_columns, keyed, unkeyed
from plumbline.operators.order_stats import leave_one_out_median, median, middle_three, quantiles
from plumbline.operators.running import running_sums
from plumbline.session import stored
from plumbline.types import Detection


def series(df: DataFrame, by: Sequence[str], key: str, value: str, order: str | None = None) -> DataFrame:
    """Series frame ``(by…, key, ord, value)``; null values stay, NaN counts as null."""
    check_columns(df, *by, key, value)
    number = F.col(value).cast("double")
    return df.select(
        *by, F.col(key).alias("key"), F.col(order or key).alias("ord"), F.when(~F.isnan(number), number).alias("value")
    )


def _groups(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.select(*by).distinct()


def _clean(value: str) -> Column:
    number = F.col(value).cast("double")
    return F.when(~F.isnan(number), number)


def _center(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Center and scale of column ``v`` for every group of ``rows``, null when n < 3."""
    center = median(rows, groups, "v")
    spread = attach(rows, center, groups, "inner").select(*groups, F.abs(F.col("v") - F.col("median")).alias("_d"))
    mad = median(spread, groups, "_d", "mad").drop("n")
    full = attach(attach(_groups(rows, groups), center, groups), mad, groups)
    enough = F.col("n") >= 3
    return full.select(
        *groups, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        F.when(enough, F.col("median")).alias("median"), F.when(enough, F.col("mad")).alias("mad"),
        F.when(enough, F.col("mad") * fixed.MAD_SCALE).alias("sigma"),
    )


def robust_center(df: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """n, median, MAD and MAD-based sigma per group; all but n null when n < 3."""
    rows, groups = keyed(df, by)
    return unkeyed(_center(rows.select(*groups, _clean(value).alias("v")), groups))


def quantile_inc(df: DataFrame, by: Sequence[str], value: str, q: float) -> DataFrame:
    """Inclusive quantile per group (linear interpolation at (n-1)*q)."""
    rows, groups = keyed(df, by)
    return unkeyed(attach(_groups(rows, groups), quantiles(rows, groups, value, {"quantile": q}), groups))


def robust_zscores(
    df: DataFrame, by: Sequence[str], key: str = "key", value: str = "value", threshold: float = 3.5, min_points: int = 8
) -> Detection:
    """Median/MAD z-scores; a point is flagged when ``abs(z) > threshold``."""
    rows, groups = keyed(df, by)
    points = stored(rows.select(*groups, F.col(key).alias("key"), _clean(value).alias("v")))
    center = stored(_center(points, groups))
    testable = (F.col("n") >= min_points) & (F.col("sigma") > 0)
    scored = attach(points, center, groups, "inner").where(testable & F.col("v").isNotNull())
    flags = scored.withColumn("score", (F.col("v") - F.col("median")) / F.col("sigma")).where(F.abs("score") > threshold).select(
        *groups, "key", F.col("v").alias("value"), F.lit("zscore").alias("reason"), "score"
    )
    counts = flags.groupBy(*groups).agg(F.count(F.lit(1)).alias("flagged"))
    reason = F.when(F.col("n") < min_points, F.format_string("only %d points (< %d)", F.col("n"), F.lit(min_points))).when(
        ~testable | F.col("sigma").isNull(), F.lit("zero MAD; values too uniform for a robust scale"))
    status = F.when(reason.isNotNull(), "inconclusive").when(F.col("flagged") > 0, "flagged").otherwise("clean")
    verdict = attach(center, counts, groups).withColumn("flagged", F.coalesce("flagged", F.lit(0).cast("bigint"))).select(
        *groups, F.lit("stat.robust_zscores").alias("method"), status.alias("status"), reason.alias("reason"),
        "n", "median", "mad", "sigma", F.lit(float(threshold)).alias("threshold"), "flagged",
    )
    return Detection(unkeyed(verdict), unkeyed(flags))


def _weekday_scores(dated: DataFrame, cell: list[str]) -> DataFrame:
    """Peer median and peer MAD of every day by two rounds of exact order statistics."""
    own = F.col("v")
    centre = middle_three(dated, cell, "v").withColumnsRenamed({"below": "xb", "mid": "xm", "above": "xa"})
    known = attach(dated, centre, cell, "inner").withColumn(
        "peer_median", leave_one_out_median(F.col("n"), F.col("xb"), F.col("xm"), F.col("xa"), own))
    sides = (F.lit(float("-inf")), F.col("xm"), F.lit(float("inf")))
    candidates = F.array_distinct(F.array(*[
        leave_one_out_median(F.col("n"), F.col("xb"), F.col("xm"), F.col("xa"), side) for side in sides]))
    away = known.select(*cell, F.explode(candidates).alias("peer_median"), "v").where(F.col("peer_median").isNotNull())
    spread = middle_three(
        away.select(*cell, "peer_median", F.abs(own - F.col("peer_median")).alias("_d")), [*cell, "peer_median"], "_d"
    ).drop("n").withColumnsRenamed({"below": "db", "mid": "dm", "above": "da"})
    scored = attach(known, spread, [*cell, "peer_median"])
    mad = leave_one_out_median(F.col("n"), F.col("db"), F.col("dm"), F.col("da"), F.abs(own - F.col("peer_median")))
    return scored.withColumn("mad", mad)


def weekday_band(
    df: DataFrame, by: Sequence[str], date: str = "key", value: str = "value", threshold: float = 3.5, min_per_weekday: int = 4
) -> Detection:
    """Each day against the other days of its own weekday (median and MAD without the day itself).

    Leaving one member out moves the median to one of three values that depend only on the middle
    of the sorted group, so no peer list is built for a day.
    """
    base, groups = keyed(df, by)
    rows = stored(base.select(*groups, F.col(date).cast("date").alias("day"), _clean(value).alias("v")))
    dated = rows.where(F.col("v").isNotNull()).withColumn("wd", F.weekday("day"))
    cell = [*groups, "wd"]
    own = F.col("v")
    scored = _weekday_scores(dated, cell)
    sigma = F.col("mad") * fixed.MAD_SCALE
    scale = F.when(sigma > 0, sigma).otherwise(F.greatest(F.lit(1.0), F.abs("peer_median") * fixed.SCALE_FLOOR_SHARE))
    judged = scored.withColumn("testable", F.col("n") >= min_per_weekday).withColumn(
        "score", F.when(F.col("testable") & (F.col("n") >= 4), (own - F.col("peer_median")) / scale))
    over = F.coalesce(F.abs("score") > threshold, F.lit(False))
    flags = judged.where(over).select(
        *groups, F.col("day").alias("key"), F.date_format("day", "EEEE").alias("weekday"), F.col("v").alias("value"),
        F.col("peer_median").alias("weekday_median"), F.lit("weekday_band").alias("reason"), "score",
    )
    counts = judged.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("points"), F.count_if(~F.col("testable")).alias("untestable_points"),
        F.count_if(over).alias("flagged"),
        # at most 7 * (min_per_weekday - 1) days can be untestable, whatever the series holds
        F.array_sort(F.collect_set(F.when(~F.col("testable"), F.col("day").cast("string")))).alias("untestable_days"),
    )
    verdict = attach(_groups(rows, groups), counts, groups)
    zero = F.lit(0).cast("bigint")
    points, flagged = F.coalesce("points", zero), F.coalesce("flagged", zero)
    untestable = F.coalesce("untestable_points", zero)
    status = F.when(points == untestable, "inconclusive").when(flagged > 0, "flagged").otherwise("clean")
    verdict = verdict.select(
        *groups, F.lit("stat.weekday_robust_band").alias("method"), status.alias("status"), points.alias("n"),
        flagged.alias("flagged"), untestable.alias("untestable_points"),
        F.coalesce("untestable_days", F.array().cast("array<string>")).alias("untestable_days"),
        F.lit(float(threshold)).alias("threshold"),
    )
    return Detection(unkeyed(verdict), unkeyed(flags))


def ratio_stability(
    df: DataFrame, by: Sequence[str], key: str, num: str, den: str, min_den: float = 30, iqr_mult: float = 1.5,
    upper_bound: float | None = None, order: str | None = None,
) -> Detection:
    """Ratio per key with a volume guard, an optional hard bound and an interquartile band (8+ points)."""
    base, groups = keyed(df, by)
    rows = base.select(*groups, F.col(key).alias("key"), F.col(order or key).alias("ord"),
                       F.col(num).cast("double").alias("numerator"), F.col(den).cast("double").alias("denominator"))
    usable = F.col("numerator").isNotNull() & F.col("denominator").isNotNull() & (F.col("denominator") != 0)
    rows = rows.withColumn("ratio", F.when(usable, F.try_divide("numerator", "denominator")))
    rows = rows.withColumn("testable", usable & (F.col("denominator") >= min_den))
    testable = rows.where("testable")
    band = quantiles(testable, groups, "ratio", {"q1": 0.25, "q3": 0.75}).drop("n")
    counts = rows.groupBy(*groups).agg(
        F.count_if("testable").alias("n"), F.count_if(~F.col("testable")).alias("low_volume"))
    reach = (F.col("q3") - F.col("q1")) * iqr_mult
    both = counts.unionByName(band, allowMissingColumns=True)  # one row per group on either side
    summary = both.groupBy(*groups).agg(*[F.max(c).alias(c) for c in ("n", "low_volume", "q1", "q3")]).withColumns({
        "band_tested": F.col("n") >= 8,
        "low": F.when(F.col("n") >= 8, F.col("q1") - reach), "high": F.when(F.col("n") >= 8, F.col("q3") + reach)})
    judged = attach(testable, summary.select(*groups, "low", "high"), groups)
    is_bound = (F.col("ratio") > upper_bound) if upper_bound is not None else F.lit(False)
    outside = F.coalesce((F.col("ratio") < F.col("low")) | (F.col("ratio") > F.col("high")), F.lit(False))
    suspects = judged.withColumns({"bound": is_bound, "band": outside}).where("bound or band")
    point = F.struct("ord", "numerator", "denominator", "ratio")
    per_key = suspects.groupBy(*groups, "key").agg(
        F.count_if("bound").alias("bounds"), F.min_by(point, F.when(F.col("band"), point)).alias("first_band"))
    bound_flags = suspects.where("bound").select(
        *groups, "key", "numerator", "denominator", "ratio", F.lit("bound").alias("reason"))
    band_flags = per_key.where("bounds = 0").select(
        *groups, "key", "first_band.numerator", "first_band.denominator", "first_band.ratio", F.lit("band").alias("reason"))
    flags = bound_flags.unionByName(band_flags)
    found = flags.groupBy(*groups).agg(
        F.count_if(F.col("reason") == "bound").alias("bound_flags"), F.count_if(F.col("reason") == "band").alias("band_flags"))
    zero = F.lit(0).cast("bigint")
    verdict = attach(summary, found, groups).withColumns(
        {"bound_flags": F.coalesce("bound_flags", zero), "band_flags": F.coalesce("band_flags", zero)})
    status = F.when(F.col("bound_flags") + F.col("band_flags") > 0, "flagged").when(F.col("n") > 0, "clean").otherwise("inconclusive")
    verdict = verdict.select(
        *groups, F.lit("stat.ratio_stability").alias("method"), status.alias("status"), "n", "low_volume", "band_tested",
        "q1", "q3", "low", "high", "bound_flags", "band_flags", F.lit(float(min_den)).alias("min_den"))
    return Detection(unkeyed(verdict), unkeyed(flags))


def _deviation(total: Column, square: Column, size: Column) -> Column:
    return square - total * total / size


def _cut_cost() -> Column:
    """Squared deviation left and right of a cut after ``idx``, from running sums."""
    return (_deviation(F.col("s1") - F.col("b1"), F.col("s2") - F.col("b2"), F.col("idx") - F.col("start"))
            + _deviation(F.col("e1") - F.col("s1"), F.col("e2") - F.col("s2"), F.col("stop") - F.col("idx")))


def _whole_cost() -> Column:
    return _deviation(F.col("e1") - F.col("b1"), F.col("e2") - F.col("b2"), F.col("stop") - F.col("start"))


def _noise_scale(noise: Column, middle: Column) -> Column:
    sigma = F.coalesce(noise, F.lit(0.0)) * fixed.MAD_SCALE / F.sqrt(F.lit(2.0))
    return F.when(sigma > 0, sigma).otherwise(F.greatest(F.lit(1.0), F.abs(middle) * fixed.SCALE_FLOOR_SHARE))


def _shifts(rows: DataFrame, groups: list[str], min_segment: int, min_shift_sigma: float, max_depth: int, examine: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segmentation of long series with a worklist: no step holds a whole series in one task.

    Running sums are computed once in chunks. The worklist holds the open segments of all series; a round finds the best cut of each
    from the running sums and the medians on both sides of it in one counted pass, closes the segments without an acceptable cut
    with the reason, and opens the two sides of the others. A round reads only series with an open segment and ends the work when none is left.
    One round beyond ``max_depth`` tells which segments the depth left unsplit; without ``examine`` all long ones count as left.
    Returns shifts, one row per series, and the final segments (first and last row number, reason).
    """
    mean = rows.groupBy(*groups).agg(F.avg("v").alias("mean"))
    centred = attach(rows, mean, groups, "inner").withColumn("c", F.col("v") - F.col("mean")).drop("mean")
    points = stored(running_sums(
        centred, groups, "ord", {"idx": F.lit(1).cast("bigint"), "s1": F.col("c"), "s2": F.col("c") * F.col("c")}, {"before": "v"}, ["key"]))
    # the level and the noise of a series are two groups of one selection
    both = points.select(*groups, F.explode(F.array(F.struct(F.lit("level").alias("_of"), F.col("v").alias("_x")),
                                                    F.struct(F.lit("noise").alias("_of"), F.abs(F.col("v") - F.col("before")).alias("_x")))).alias("_p")).select(*groups, "_p.*")
    scales = median(both, [*groups, "_of"], "_x").groupBy(*groups).agg(
        F.max(F.when(F.col("_of") == "level", F.struct("n", "median"))).alias("_l"), F.max(F.when(F.col("_of") == "noise", F.col("median"))).alias("_n"))
    whole = points.groupBy(*groups).agg(F.max(F.struct("idx", "s1", "s2")).alias("e"))
    zero = F.lit(0.0)
    # a segment covers idx in (start, stop]; b1/b2 and e1/e2 are the running sums at its two ends
    segments = stored(attach(whole, scales, groups).select(
        *groups, F.lit(0).cast("bigint").alias("start"), F.col("e.idx").alias("stop"), zero.alias("b1"), zero.alias("b2"), F.col("e.s1").alias("e1"), F.col("e.s2").alias("e2"),
        F.col("_l.n").alias("n"), _noise_scale(F.col("_n"), F.col("_l.median")).alias("scale")))
    series_rows = segments.select(*groups, "n", "scale")
    segments = segments.drop("n")
    accepted, closed = [], []
    for level in range(max_depth + 1):
        long = F.col("stop") - F.col("start") >= 2 * min_segment
        closed.append(segments.where(~long).select(*groups, "start", "stop", F.lit("too short to split").alias("reason")))
        if level == max_depth and not examine:
            closed.append(segments.where(long).select(*groups, "start", "stop", F.lit("depth reached").alias("reason")))
            break
        parts = segments.where(long).groupBy(*groups).agg(F.collect_list(F.struct("start", "stop", "b1", "b2", "e1", "e2", "scale")).alias("parts"))  # 2 ** max_depth at most
        inside = attach(points.select(*groups, "v", "idx", "s1", "s2"), parts, groups, "inner").withColumn("part", F.get(F.filter(
            "parts", lambda p: (F.col("idx") > p["start"]) & (F.col("idx") <= p["stop"])), F.lit(0))).where("part is not null")
        inside = inside.select(*groups, "v", "idx", "s1", "s2", "part.*")
        cuts = inside.where((F.col("idx") - F.col("start") >= min_segment) & (F.col("stop") - F.col("idx") >= min_segment))
        ends = ["stop", "b1", "b2", "e1", "e2", "scale"]
        best = cuts.groupBy(*groups, "start").agg(F.min(F.struct(_cut_cost().alias("cost"), "idx", "s1", "s2", *ends)).alias("m"))
        best = stored(best.select(*groups, "start", *[F.col(f"m.{c}").alias(c) for c in ends], F.col("m.cost").alias("cost"), F.col("m.idx").alias("cut"), F.col("m.s1").alias("m1"), F.col("m.s2").alias("m2")))
        gains = best.where(F.col("cost") < _whole_cost())
        sides = attach(inside.select(*groups, "start", "idx", "v"), gains.select(*groups, "start", "cut"), [*groups, "start"], "inner")
        sides = sides.withColumn("side", F.when(F.col("idx") <= F.col("cut"), "l").otherwise("r"))
        levels = median(sides, [*groups, "start", "side"], "v").groupBy(*groups, "start").agg(
            F.max(F.when(F.col("side") == "l", F.col("median"))).alias("before_median"),
            F.max(F.when(F.col("side") == "r", F.col("median"))).alias("after_median"))
        judged = attach(best, levels, [*groups, "start"]).withColumn("score", (F.col("after_median") - F.col("before_median")) / F.col("scale"))
        fits = F.coalesce(F.abs("score") >= min_shift_sigma, F.lit(False))
        watch = Observation()
        judged = stored(judged.withColumn("fits", fits).observe(watch, F.count_if("fits").alias("shifts")))
        reason = F.when(F.col("before_median").isNull(), "no cut lowers the deviation").when(~F.col("fits"), "shift below the threshold").otherwise("depth reached")
        ended = ~F.col("fits") | F.lit(level == max_depth)
        closed.append(judged.where(ended).select(*groups, "start", "stop", reason.alias("reason")))
        if level == max_depth:
            break
        shifts = judged.where("fits")
        accepted.append(shifts.select(*groups, (F.col("cut") + 1).alias("idx"), "before_median", "after_median", "score"))
        segments = shifts.select(*groups, F.explode(F.array(
            F.struct(F.col("start"), F.col("cut").alias("stop"), "b1", "b2", F.col("m1").alias("e1"), F.col("m2").alias("e2"), "scale"),
            F.struct(F.col("cut").alias("start"), "stop", F.col("m1").alias("b1"), F.col("m2").alias("b2"), "e1", "e2", "scale"),
        )).alias("s")).select(*groups, "s.*")
        if watch.get["shifts"] == 0:
            break
    segments = reduce(DataFrame.unionByName, closed)
    if not accepted:
        empty = points.limit(0)
        shifts = empty.select(*groups, "key", *[F.lit(None).cast("double").alias(c) for c in ("before_median", "after_median", "score")])
    else:
        shifts = attach(reduce(DataFrame.unionByName, accepted), points.select(*groups, "idx", "key"), [*groups, "idx"], "inner").drop("idx")
    counts = shifts.groupBy(*groups).agg(F.count(F.lit(1)).alias("shifts"))
    cut_off = segments.where("reason = 'depth reached'").groupBy(*groups).agg(F.count(F.lit(1)).alias("unsplit"))
    return shifts, attach(attach(series_rows, counts, groups), cut_off, groups), segments


def changepoints(
    df: DataFrame, by: Sequence[str], order: str = "ord", value: str = "value", key: str = "key",
    min_segment: int = 7, min_shift_sigma: float = 2.0, max_depth: int = 3, examine: bool = True,
) -> Detection:
    """Level shifts by binary segmentation on squared deviation, with a first-difference noise scale.

    The cost of every cut is a difference of running sums of the centred series. ``unsplit`` of the verdict counts segments with an acceptable
    cut that ``max_depth`` left whole, or without ``examine``, which saves a round, those it left unexamined; ``changepoint_segments`` lists all segments with the reason they were not split.
    """
    base, groups = keyed(df, by)
    rows = base.select(*groups, F.col(order).alias("ord"), F.col(key).alias("key"), _clean(value).alias("v"))
    present = rows.where(F.col("v").isNotNull())
    shifts, summary, _ = _shifts(present, groups, min_segment, min_shift_sigma, max_depth, examine)
    flags = shifts.select(*groups, "key", "before_median", "after_median", F.lit("level_shift").alias("reason"), "score")
    verdict = attach(_groups(rows, groups), summary, groups)
    zero = F.lit(0).cast("bigint")
    n, found = F.coalesce("n", zero), F.coalesce("shifts", zero)
    status = F.when(n < 2 * min_segment, "inconclusive").when(found > 0, "flagged").otherwise("clean")
    verdict = verdict.select(
        *groups, F.lit("stat.changepoints").alias("method"), status.alias("status"), n.alias("n"),
        F.when(n >= 2 * min_segment, F.col("scale")).alias("scale"), found.alias("shifts"), F.coalesce("unsplit", zero).alias("unsplit"))
    return Detection(unkeyed(verdict), unkeyed(flags))


def changepoint_segments(
    df: DataFrame, by: Sequence[str], order: str = "ord", value: str = "value", key: str = "key",
    min_segment: int = 7, min_shift_sigma: float = 2.0, max_depth: int = 3,
) -> DataFrame:
    """The segments that ``changepoints`` ends with: row numbers of the first and last value (nulls not counted) and why it was not split."""
    base, groups = keyed(df, by)
    rows = base.select(*groups, F.col(order).alias("ord"), F.col(key).alias("key"), _clean(value).alias("v")).where(F.col("v").isNotNull())
    segments = _shifts(rows, groups, min_segment, min_shift_sigma, max_depth, True)[2]
    return unkeyed(segments.select(*groups, (F.col("start") + 1).alias("first"), F.col("stop").alias("last"), "reason"))


def psi(
    df: DataFrame, by: Sequence[str], label: str, period: str, value: str, baseline, current, threshold: float = 0.25,
    top: int = 8,
) -> Detection:
    """Population stability index between two periods' category mix; flags are the top contributors."""
    base, groups = keyed(df, by)
    amount = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    in_base, in_now = F.col(period) == F.lit(baseline), F.col(period) == F.lit(current)
    labels = base.where(in_base | in_now).groupBy(*groups, F.col(label).alias("label")).agg(
        F.sum(F.when(in_base, amount)).alias("b"), F.sum(F.when(in_now, amount)).alias("c"))
    totals = labels.groupBy(*groups).agg(F.sum("b").alias("bt"), F.sum("c").alias("ct"))

    def share(part, whole):
        total = F.coalesce(F.col(whole), F.lit(0.0))
        return F.coalesce(F.col(part), F.lit(0.0)) / F.when(total == 0, 1.0).otherwise(total)

    parts = attach(labels, totals, groups, "inner").withColumns({
        "baseline_share": share("b", "bt"), "current_share": share("c", "ct"),
        "one_sided": F.col("b").isNull() | F.col("c").isNull()})
    floored_b = F.greatest("baseline_share", F.lit(fixed.PSI_FLOOR))
    floored_c = F.greatest("current_share", F.lit(fixed.PSI_FLOOR))
    parts = parts.withColumn("score", (floored_c - floored_b) * F.ln(floored_c / floored_b))
    summary = parts.groupBy(*groups).agg(
        F.sum("score").alias("psi"), F.count(F.lit(1)).alias("n"), F.count_if("one_sided").alias("new_or_missing"))
    verdict = attach(_groups(base, groups), summary, groups)
    value_of = F.coalesce("psi", F.lit(0.0))
    zero = F.lit(0).cast("bigint")
    verdict = verdict.select(
        *groups, F.lit("stat.population_stability").alias("method"),
        F.when(value_of > threshold, "flagged").otherwise("clean").alias("status"), F.coalesce("n", zero).alias("n"),
        value_of.alias("psi"), F.lit(float(threshold)).alias("threshold"), F.coalesce("new_or_missing", zero).alias("new_or_missing"))
    largest = Window.partitionBy(*groups).orderBy(F.abs(F.round("score", 4)).desc(), F.col("label").cast("string"))
    flags = parts.withColumn("rank", F.row_number().over(largest)).where(F.col("rank") <= top).select(
        *groups, F.col("label").alias("key"), "baseline_share", "current_share", "one_sided", "score", "rank")
    return Detection(unkeyed(verdict), unkeyed(flags))


def one_sided_labels(df: DataFrame, by: Sequence[str], label: str, period: str, baseline, current) -> DataFrame:
    """Labels that occur in only one of the two periods."""
    base, groups = keyed(df, by)
    in_base, in_now = F.col(period) == F.lit(baseline), F.col(period) == F.lit(current)
    seen = base.where(in_base | in_now).groupBy(*groups, F.col(label).alias("label")).agg(
        F.bool_or(in_base).alias("in_baseline"), F.bool_or(in_now).alias("in_current"))
    return unkeyed(seen.where("in_baseline != in_current"))


def additivity(
    parts: DataFrame, total: DataFrame, by: Sequence[str], value: str = "value", total_value: str = "total",
    tolerance: float = 0.5,
) -> DataFrame:
    """Do the members add up to the stated total? ``total`` holds one row per group."""
    members, groups = keyed(parts, by)
    stated, _ = keyed(total, by)
    summed = members.groupBy(*groups).agg(
        F.sum(F.col(value).cast("double")).alias("parts_sum"), F.count(F.lit(1)).alias("parts"))
    stated = stated.select(*groups, F.col(total_value).cast("double").alias("total"))
    joined = attach(stated, summed, groups).withColumns({
        "parts_sum": F.coalesce("parts_sum", F.lit(0.0)), "parts": F.coalesce("parts", F.lit(0).cast("bigint"))})
    joined = joined.withColumn("remainder", F.col("total") - F.col("parts_sum"))
    return unkeyed(joined.select(
        *groups, F.lit("dax.additivity").alias("method"),
        F.when(F.abs("remainder") <= tolerance, "clean").otherwise("flagged").alias("status"),
        "parts", "parts_sum", "total", "remainder", F.lit(float(tolerance)).alias("tolerance")))


def ratio_of_totals_vs_mean(df: DataFrame, by: Sequence[str], num: str, den: str) -> DataFrame:
    """Ratio of the sums against the mean of the members' own ratios."""
    rows, groups = keyed(df, by)
    n, d = F.col(num).cast("double"), F.col(den).cast("double")
    member = F.try_divide(n, F.nullif(d, F.lit(0.0)))
    out = rows.groupBy(*groups).agg(
        F.coalesce(F.sum(n), F.lit(0.0)).alias("num"), F.coalesce(F.sum(d), F.lit(0.0)).alias("den"),
        F.avg(member).alias("mean_of_member_ratios"), F.count(member).alias("members"))
    out = out.withColumn("ratio_of_totals", F.try_divide("num", F.nullif(F.col("den"), F.lit(0.0))))
    return unkeyed(out.select(
        *groups, F.lit("stat.ratio_of_totals_vs_mean_of_ratios").alias("method"), F.lit("informational").alias("status"),
        "ratio_of_totals", "mean_of_member_ratios",
        (F.col("mean_of_member_ratios") - F.col("ratio_of_totals")).alias("gap"), "members"))


def fan_out(
    base: DataFrame, path: DataFrame, base_key: Sequence[str], path_key: Sequence[str], business_key: Sequence[str] | None = None,
    as_assertion: bool = False,
) -> DataFrame:
    """Row multiplication of ``base`` through an inner join with ``path``, without doing the join.

    Both sides are counted per join key first, so a hot key contributes one multiplication
    instead of all its pairs. A null business key counts as one distinct value.
    """
    left = base.groupBy(*base_key).agg(F.count(F.lit(1)).alias("_l"))
    right = path.groupBy(*path_key).agg(F.count(F.lit(1)).alias("_r")).withColumnsRenamed({k: f"_r_{k}" for k in path_key})
    pairs = None
    for a, b in zip(base_key, path_key):
        condition = F.col(a) == F.col(f"_r_{b}")
        pairs = condition if pairs is None else pairs & condition
    counts = left.join(right, pairs, "left").agg(
        F.coalesce(F.sum("_l"), F.lit(0)).alias("base_rows"),
        F.coalesce(F.sum(F.col("_l").cast("decimal(19,0)") * F.coalesce("_r", F.lit(0).cast("bigint")).cast("decimal(19,0)")), F.lit(0)).alias("joined_rows"),
        F.coalesce(F.sum(F.when(F.col("_r").isNull(), F.col("_l"))), F.lit(0)).alias("unmatched_rows"))
    if business_key:
        distinct = base.select(*business_key).distinct().agg(F.count(F.lit(1)))
        counts = counts.withColumn("distinct_keys", distinct.scalar())
    else:
        counts = counts.withColumn("distinct_keys", F.lit(None).cast("bigint"))
    off = (F.col("joined_rows") != F.col("base_rows")) | F.coalesce(F.col("distinct_keys") != F.col("base_rows"), F.lit(False))
    worst = "failed" if as_assertion else "flagged"
    return counts.select(
        F.lit("dax.fan_out").alias("method"), F.when(off, worst).otherwise("clean").alias("status"), "base_rows", "joined_rows",
        F.try_divide("joined_rows", "base_rows").alias("multiplier"), "unmatched_rows", "distinct_keys",
        (F.col("base_rows") - F.col("distinct_keys")).alias("duplicate_rows"))


def profile(df: DataFrame, by: Sequence[str], column: str, complete: bool = True) -> DataFrame:
    """Descriptive statistics of one column: count, mean, sample deviation, range, five quantiles."""
    rows, groups = keyed(df, by)
    number = F.col(column).try_cast("double")
    rows = rows.select(*groups, F.col(column).alias("_raw"), F.when(~F.isnan(number), number).alias("_n"))
    raw_null = F.col("_raw").isNull()
    if dict(df.dtypes)[column] in ("double", "float"):
        raw_null = raw_null | F.isnan("_raw")

    def finite(expr):
        return F.when(~F.isnan(expr) & (F.abs(expr) != float("inf")), expr)

    basic = rows.groupBy(*groups).agg(
        F.count("_n").alias("count"), finite(F.avg("_n")).alias("mean"), finite(F.stddev_samp("_n")).alias("std"),
        finite(F.min("_n")).alias("min"), finite(F.max("_n")).alias("max"), F.count_if(raw_null).alias("null_count"),
        F.count_if(~raw_null & F.col("_n").isNull()).alias("invalid_numeric"))
    levels = quantiles(rows, groups, "_n", {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99}).drop("n")
    out = attach(basic, levels, groups)
    return unkeyed(out.select(
        *groups, F.lit(column).alias("column"), F.lit(complete).alias("complete"), "count", "mean", "std", "min",
        *[finite(F.col(p)).alias(p) for p in ("p01", "p25", "p50", "p75", "p99")], "max", "null_count", "invalid_numeric"))


def sum_squared_deviation(df: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Sum of squared deviations from the group mean (0 for an empty group)."""
    rows, groups = keyed(df, by)
    out = rows.groupBy(*groups).agg(
        F.coalesce(F.var_pop(F.col(value).cast("double")) * F.count(value), F.lit(0.0)).alias("sum_squared_deviation"))
    return unkeyed(out)
