"""Series statistics on order, event and line-item data."""

from pyspark.sql import functions as F

from checks.base import DAILY, daily_revenue, money, query, rounded, table
from plumbline.functions.scalars import as_date
from plumbline.operators import series_stats as s

BY = ["o_orderpriority"]


def _series(spark, sf):
    return s.series(daily_revenue(spark, sf), BY, "day", "revenue")


@query("series_points", f"""WITH {DAILY}
SELECT o_orderpriority, CAST(day AS VARCHAR) AS key, ROUND(revenue, 4) AS value FROM daily""")
def series_points(spark, sf):
    return rounded(_series(spark, sf).select(*BY, "key", "value"))


@query("date_layouts", """
SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, COUNT(*) AS rows FROM orders GROUP BY 1""")
def date_layouts(spark, sf):
    """Every order date written in one of five layouts and read back."""
    d = F.col("o_orderdate")
    layouts = F.array(F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "MM/dd/yyyy hh:mm:ss a"), F.date_format(d, "M/d/yyyy"),
                      F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(d, "yyyy-MM-dd HH:mm:ss"))
    text = F.get(layouts, (F.col("o_orderkey") % 5).cast("int"))
    return rounded(table(spark, sf, "orders").select(as_date(text).alias("day")).groupBy("day").agg(F.count(F.lit(1)).alias("rows")))


CENTER = DAILY + """,
mid AS (SELECT o_orderpriority, MEDIAN(revenue) AS m, COUNT(*) AS n FROM daily GROUP BY 1),
spread AS (SELECT d.o_orderpriority, MEDIAN(ABS(revenue - m)) AS mad FROM daily d JOIN mid USING (o_orderpriority) GROUP BY 1),
center AS (SELECT o_orderpriority, n, m, mad, mad * 1.4826 AS sigma FROM mid JOIN spread USING (o_orderpriority))"""


@query("robust_center", f"""WITH {CENTER}
SELECT o_orderpriority, n, ROUND(m, 4) AS median, ROUND(mad, 4) AS mad, ROUND(sigma, 4) AS sigma FROM center""")
def robust_center(spark, sf):
    return rounded(s.robust_center(_series(spark, sf), BY))


@query("quantile_inc", f"""WITH {DAILY}
SELECT o_orderpriority, COUNT(*) AS n, ROUND(QUANTILE_CONT(revenue, 0.9), 4) AS quantile FROM daily GROUP BY 1""")
def quantile_inc(spark, sf):
    return rounded(s.quantile_inc(_series(spark, sf), BY, "value", 0.9))


@query("robust_zscore_verdict", f"""WITH {CENTER}
SELECT o_orderpriority, CASE WHEN n < 8 OR sigma = 0 THEN 'inconclusive' WHEN flagged > 0 THEN 'flagged' ELSE 'clean' END AS status,
  n, ROUND(m, 4) AS median, flagged
FROM (SELECT o_orderpriority, MAX(n) AS n, MAX(m) AS m, MAX(sigma) AS sigma, COUNT(*) FILTER (WHERE ABS((revenue - m) / sigma) > 3.5) AS flagged
      FROM daily JOIN center USING (o_orderpriority) GROUP BY 1)""")
def robust_zscore_verdict(spark, sf):
    return rounded(s.robust_zscores(_series(spark, sf), BY).verdict.select(*BY, "status", "n", "median", "flagged"))


@query("robust_zscore_flags", f"""WITH {CENTER}
SELECT o_orderpriority, CAST(day AS VARCHAR) AS key, ROUND(revenue, 4) AS value, ROUND((revenue - m) / sigma, 4) AS score
FROM daily JOIN center USING (o_orderpriority) WHERE ABS((revenue - m) / sigma) > 3.5""")
def robust_zscore_flags(spark, sf):
    return rounded(s.robust_zscores(_series(spark, sf), BY).flags.select(*BY, "key", "value", "score"))


WEEKDAY = DAILY + """,
w AS (SELECT *, ISODOW(day) AS wd, ROW_NUMBER() OVER () AS id FROM daily),
pairs AS (SELECT a.id, a.o_orderpriority, a.day, a.revenue, b.revenue AS peer
          FROM w a JOIN w b ON a.o_orderpriority = b.o_orderpriority AND a.wd = b.wd AND a.id <> b.id),
med AS (SELECT id, MEDIAN(peer) AS m, COUNT(*) AS peers FROM pairs GROUP BY 1),
mads AS (SELECT id, MEDIAN(ABS(peer - m)) * 1.4826 AS sigma FROM pairs JOIN med USING (id) GROUP BY 1),
judged AS (SELECT w.o_orderpriority, w.day, w.revenue, m, peers,
             CASE WHEN peers >= 3 THEN (w.revenue - m) / CASE WHEN sigma > 0 THEN sigma ELSE GREATEST(1.0, ABS(m) * 0.02) END END AS z
           FROM w LEFT JOIN med USING (id) LEFT JOIN mads USING (id))"""


@query("weekday_band_flags", f"""WITH {WEEKDAY}
SELECT o_orderpriority, CAST(day AS VARCHAR) AS key, DAYNAME(day) AS weekday, ROUND(revenue, 4) AS value, ROUND(m, 4) AS weekday_median,
  ROUND(z, 4) AS score FROM judged WHERE ABS(z) > 3.5""")
def weekday_band_flags(spark, sf):
    return rounded(s.weekday_band(_series(spark, sf), BY).flags.drop("reason"))


@query("weekday_band_verdict", f"""WITH {WEEKDAY}
SELECT o_orderpriority, CASE WHEN COUNT(*) = COUNT(*) FILTER (WHERE COALESCE(peers, 0) < 3) THEN 'inconclusive'
    WHEN COUNT(*) FILTER (WHERE ABS(z) > 3.5) > 0 THEN 'flagged' ELSE 'clean' END AS status, COUNT(*) AS n,
  COUNT(*) FILTER (WHERE ABS(z) > 3.5) AS flagged, COUNT(*) FILTER (WHERE COALESCE(peers, 0) < 3) AS untestable_points
FROM judged GROUP BY 1""")
def weekday_band_verdict(spark, sf):
    return rounded(s.weekday_band(_series(spark, sf), BY).verdict.select(*BY, "status", "n", "flagged", "untestable_points"))


def _daily_ratio(spark, sf):
    events = table(spark, sf, "events")
    return events.groupBy(F.to_date("ts").alias("day")).agg(
        F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.count_if(F.col("event_type") == "view").alias("views"))


RATIO = """r AS (SELECT CAST(ts AS DATE) AS day, COUNT(*) FILTER (WHERE event_type = 'purchase') AS num, COUNT(*) FILTER (WHERE event_type = 'view') AS den
       FROM events GROUP BY 1),
t AS (SELECT day, num, den, CAST(num AS DOUBLE) / den AS ratio FROM r WHERE den >= 30),
q AS (SELECT COUNT(*) AS n, QUANTILE_CONT(ratio, 0.25) AS q1, QUANTILE_CONT(ratio, 0.75) AS q3 FROM t),
band AS (SELECT n, q1, q3, CASE WHEN n >= 8 THEN q1 - 0.7 * (q3 - q1) END AS low, CASE WHEN n >= 8 THEN q3 + 0.7 * (q3 - q1) END AS high FROM q),
flags AS (SELECT day, num, den, ratio, CASE WHEN ratio > 1.3 THEN 'bound' ELSE 'band' END AS reason FROM t, band
          WHERE ratio > 1.3 OR ratio < low OR ratio > high)"""


@query("ratio_stability_flags", f"""WITH {RATIO}
SELECT CAST(day AS VARCHAR) AS key, CAST(num AS DOUBLE) AS numerator, CAST(den AS DOUBLE) AS denominator, ROUND(ratio, 6) AS ratio, reason FROM flags""")
def ratio_stability_flags(spark, sf):
    return rounded(s.ratio_stability(_daily_ratio(spark, sf), [], "day", "purchases", "views", iqr_mult=0.7, upper_bound=1.3).flags, 6)


@query("ratio_stability_verdict", f"""WITH {RATIO}
SELECT CASE WHEN (SELECT COUNT(*) FROM flags) > 0 THEN 'flagged' WHEN n > 0 THEN 'clean' ELSE 'inconclusive' END AS status, n,
  (SELECT COUNT(*) FROM r) - n AS low_volume, n >= 8 AS band_tested, ROUND(q1, 6) AS q1, ROUND(q3, 6) AS q3, ROUND(low, 6) AS low, ROUND(high, 6) AS high,
  (SELECT COUNT(*) FROM flags WHERE reason = 'bound') AS bound_flags, (SELECT COUNT(*) FROM flags WHERE reason = 'band') AS band_flags FROM band""")
def ratio_stability_verdict(spark, sf):
    return rounded(s.ratio_stability(_daily_ratio(spark, sf), [], "day", "purchases", "views", iqr_mult=0.7, upper_bound=1.3).verdict.drop("method", "min_den"), 6)


def _changepoint_sql(min_segment: int, sigma: float, depth: int) -> str:
    ctes = [DAILY, """
pts AS (SELECT o_orderpriority AS p, day, revenue AS v, ROW_NUMBER() OVER (PARTITION BY o_orderpriority ORDER BY day) AS idx,
          revenue - AVG(revenue) OVER (PARTITION BY o_orderpriority) AS c, revenue - LAG(revenue) OVER (PARTITION BY o_orderpriority ORDER BY day) AS diff FROM daily),
sums AS (SELECT *, SUM(c) OVER (PARTITION BY p ORDER BY idx) AS s1, SUM(c * c) OVER (PARTITION BY p ORDER BY idx) AS s2 FROM pts),
noise AS (SELECT p, COUNT(*) AS n, MEDIAN(ABS(diff)) * 1.4826 / SQRT(2.0) AS s, MEDIAN(v) AS m FROM pts GROUP BY 1),
scale AS (SELECT p, n, CASE WHEN s > 0 THEN s ELSE GREATEST(1.0, ABS(m) * 0.02) END AS scale FROM noise),
seg0 AS (SELECT p, CAST(0 AS BIGINT) AS a, MAX(idx) AS b FROM pts GROUP BY 1)"""]
    for k in range(depth + 1):
        ctes.append(f"""
ends{k} AS (SELECT s.p, s.a, s.b, COALESCE(x.s1, 0) AS a1, COALESCE(x.s2, 0) AS a2, y.s1 AS b1, y.s2 AS b2
            FROM seg{k} s LEFT JOIN sums x ON x.p = s.p AND x.idx = s.a JOIN sums y ON y.p = s.p AND y.idx = s.b),
cost{k} AS (SELECT e.*, u.idx AS cut, (u.s2 - a2) - (u.s1 - a1) * (u.s1 - a1) / (u.idx - a) + (b2 - u.s2) - (b1 - u.s1) * (b1 - u.s1) / (b - u.idx) AS cost,
              (b2 - a2) - (b1 - a1) * (b1 - a1) / (b - a) AS total
            FROM ends{k} e JOIN sums u ON u.p = e.p AND u.idx - e.a >= {min_segment} AND e.b - u.idx >= {min_segment}),
best{k} AS (SELECT * FROM cost{k} QUALIFY ROW_NUMBER() OVER (PARTITION BY p, a ORDER BY cost, cut) = 1),
level{k} AS (SELECT b.p, b.a, b.b, b.cut, b.cost, b.total, MEDIAN(v) FILTER (WHERE idx <= cut) AS before_median, MEDIAN(v) FILTER (WHERE idx > cut) AS after_median
             FROM best{k} b JOIN pts t ON t.p = b.p AND t.idx > b.a AND t.idx <= b.b GROUP BY ALL),
shift{k} AS (SELECT l.*, (after_median - before_median) / scale AS score FROM level{k} l JOIN scale USING (p)
             WHERE ABS((after_median - before_median) / scale) >= {sigma} AND cost < total),
seg{k + 1} AS (SELECT p, a, cut AS b FROM shift{k} UNION ALL SELECT p, cut AS a, b FROM shift{k})""")
    ctes.append("\nshifts AS (" + " UNION ALL ".join(f"SELECT p, cut + 1 AS idx, before_median, after_median, score FROM shift{k}" for k in range(depth)) + ")")
    ends = []
    for k in range(depth + 1):
        ends.append(f"SELECT p, a, b, 'too short to split' AS reason FROM seg{k} WHERE b - a < {2 * min_segment}")
        reason = f"CASE WHEN cost >= total THEN 'no cut lowers the deviation' WHEN ABS((after_median - before_median) / scale) < {sigma} THEN 'shift below the threshold' ELSE 'depth reached' END"
        stays = "TRUE" if k == depth else f"(p, a) NOT IN (SELECT (p, a) FROM shift{k})"
        ends.append(f"SELECT p, a, b, {reason} FROM level{k} JOIN scale USING (p) WHERE {stays}")
    ctes.append("\nsegments AS (" + " UNION ALL ".join(ends) + ")")
    return ",".join(ctes)


CHANGES = _changepoint_sql(7, 0.05, 3)


@query("changepoint_shifts", f"""WITH {CHANGES}
SELECT p AS o_orderpriority, CAST(day AS VARCHAR) AS key, ROUND(before_median, 4) AS before_median, ROUND(after_median, 4) AS after_median, ROUND(score, 6) AS score
FROM shifts JOIN pts USING (p, idx)""")
def changepoint_shifts(spark, sf):
    flags = s.changepoints(_series(spark, sf), BY, min_shift_sigma=0.05, examine=False).flags.drop("reason")
    return rounded(flags.withColumns({"before_median": F.round("before_median", 4), "after_median": F.round("after_median", 4)}), 6)


@query("changepoint_verdict", f"""WITH {CHANGES}
SELECT p AS o_orderpriority, CASE WHEN n < 14 THEN 'inconclusive' WHEN shifts > 0 THEN 'flagged' ELSE 'clean' END AS status, n, ROUND(scale, 4) AS scale, shifts, unsplit
FROM (SELECT p, n, CASE WHEN n >= 14 THEN scale END AS scale, (SELECT COUNT(*) FROM shifts x WHERE x.p = scale.p) AS shifts,
  (SELECT COUNT(*) FROM segments g WHERE g.p = scale.p AND reason = 'depth reached') AS unsplit FROM scale)""")
def changepoint_verdict(spark, sf):
    return rounded(s.changepoints(_series(spark, sf), BY, min_shift_sigma=0.05).verdict.drop("method"))


@query("changepoint_segments", f"WITH {CHANGES} SELECT p AS o_orderpriority, a + 1 AS first, b AS last, reason FROM segments")
def changepoint_segments(spark, sf):
    """All segments with the reason why each was not split further."""
    return s.changepoint_segments(_series(spark, sf), BY, min_shift_sigma=0.05)


def _mix(spark, sf):
    half = F.when(F.to_date("ts") < F.lit("2024-01-16").cast("date"), "first").otherwise("second")
    return table(spark, sf, "events").groupBy(F.col("event_type"), half.alias("half")).agg(F.count(F.lit(1)).alias("events"))


MIX = """m AS (SELECT event_type AS label, COUNT(*) FILTER (WHERE CAST(ts AS DATE) < DATE '2024-01-16') AS b,
            COUNT(*) FILTER (WHERE CAST(ts AS DATE) >= DATE '2024-01-16') AS c FROM events GROUP BY 1),
sh AS (SELECT label, b / CAST(SUM(b) OVER () AS DOUBLE) AS bs, c / CAST(SUM(c) OVER () AS DOUBLE) AS cs, b = 0 OR c = 0 AS one_sided FROM m),
terms AS (SELECT *, (GREATEST(cs, 1e-4) - GREATEST(bs, 1e-4)) * LN(GREATEST(cs, 1e-4) / GREATEST(bs, 1e-4)) AS term FROM sh)"""


@query("population_stability_verdict", f"""WITH {MIX}
SELECT CASE WHEN SUM(term) > 0.25 THEN 'flagged' ELSE 'clean' END AS status, COUNT(*) AS n, ROUND(SUM(term), 8) AS psi,
  COUNT(*) FILTER (WHERE one_sided) AS new_or_missing FROM terms""")
def population_stability_verdict(spark, sf):
    return rounded(s.psi(_mix(spark, sf), [], "event_type", "half", "events", "first", "second").verdict.drop("method", "threshold"), 8)


@query("population_stability_contributors", f"""WITH {MIX}
SELECT label AS key, ROUND(bs, 8) AS baseline_share, ROUND(cs, 8) AS current_share, one_sided, ROUND(term, 8) AS score,
  ROW_NUMBER() OVER (ORDER BY ABS(ROUND(term, 4)) DESC, label) AS rank FROM terms QUALIFY rank <= 8""")
def population_stability_contributors(spark, sf):
    return rounded(s.psi(_mix(spark, sf), [], "event_type", "half", "events", "first", "second").flags, 8)


@query("one_sided_labels", """
SELECT CAST(YEAR(o_orderdate) AS VARCHAR) AS label, FALSE AS in_baseline, TRUE AS in_current FROM orders GROUP BY 1
HAVING COUNT(*) FILTER (WHERE o_orderstatus = 'F') > 0 AND COUNT(*) FILTER (WHERE o_orderstatus = 'Z') = 0""")
def one_sided_labels(spark, sf):
    orders = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate").cast("string"))
    return s.one_sided_labels(orders, [], "year", "o_orderstatus", "Z", "F")


@query("additivity", """
SELECT l_linestatus, CASE WHEN ABS(total - parts_sum) <= 0.5 THEN 'clean' ELSE 'flagged' END AS status, parts, ROUND(parts_sum, 2) AS parts_sum,
  ROUND(total, 2) AS total, ROUND(total - parts_sum, 2) AS remainder
FROM (SELECT l_linestatus, CAST(SUM(v) AS DOUBLE) AS parts_sum, COUNT(*) AS parts FROM (
        SELECT l_linestatus, l_returnflag, SUM(CAST(l_extendedprice AS DECIMAL(18,4))) AS v FROM lineitem WHERE l_discount > 0 GROUP BY 1, 2) GROUP BY 1)
JOIN (SELECT l_linestatus, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS total FROM lineitem GROUP BY 1) USING (l_linestatus)""")
def additivity(spark, sf):
    """A breakdown that lost its undiscounted rows against the full total."""
    items = table(spark, sf, "lineitem")
    parts = items.where("l_discount > 0").groupBy("l_linestatus", "l_returnflag").agg(F.sum(money("l_extendedprice")).alias("value"))
    total = items.groupBy("l_linestatus").agg(F.sum(money("l_extendedprice")).alias("total"))
    return rounded(s.additivity(parts, total, ["l_linestatus"]).drop("method", "tolerance"), 2)


@query("ratio_of_totals_vs_mean", """
SELECT l_returnflag, ROUND(num / den, 8) AS ratio_of_totals, ROUND(mean, 8) AS mean_of_member_ratios, ROUND(mean - num / den, 8) AS gap, members
FROM (SELECT l_returnflag, SUM(l_extendedprice * l_discount) AS num, SUM(l_extendedprice) AS den,
        AVG(l_extendedprice * l_discount / l_extendedprice) AS mean, COUNT(l_extendedprice * l_discount / l_extendedprice) AS members FROM lineitem GROUP BY 1)""")
def ratio_of_totals_vs_mean(spark, sf):
    items = table(spark, sf, "lineitem").withColumn("discount_amount", F.col("l_extendedprice") * F.col("l_discount"))
    return rounded(s.ratio_of_totals_vs_mean(items, ["l_returnflag"], "discount_amount", "l_extendedprice").drop("method", "status"), 8)


@query("fan_out", """
WITH p AS (SELECT COUNT(*) AS joined FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT CASE WHEN joined <> base OR keys <> base THEN 'flagged' ELSE 'clean' END AS status, base AS base_rows, CAST(joined AS DOUBLE) AS joined_rows,
  ROUND(joined / CAST(base AS DOUBLE), 8) AS multiplier, unmatched AS unmatched_rows, keys AS distinct_keys, base - keys AS duplicate_rows
FROM p, (SELECT COUNT(*) AS base, COUNT(DISTINCT o_orderkey) AS keys, COUNT(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)) AS unmatched FROM orders)""")
def fan_out(spark, sf):
    orders, items = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    return rounded(s.fan_out(orders, items, ["o_orderkey"], ["l_orderkey"], ["o_orderkey"]).drop("method"), 8)


@query("column_profile", """
SELECT 'l_extendedprice' AS "column", COUNT(l_extendedprice) AS count, ROUND(AVG(l_extendedprice), 4) AS mean, ROUND(STDDEV_SAMP(l_extendedprice), 4) AS std,
  ROUND(MIN(l_extendedprice), 4) AS min, ROUND(QUANTILE_CONT(l_extendedprice, 0.01), 4) AS p01, ROUND(QUANTILE_CONT(l_extendedprice, 0.25), 4) AS p25,
  ROUND(QUANTILE_CONT(l_extendedprice, 0.5), 4) AS p50, ROUND(QUANTILE_CONT(l_extendedprice, 0.75), 4) AS p75, ROUND(QUANTILE_CONT(l_extendedprice, 0.99), 4) AS p99,
  ROUND(MAX(l_extendedprice), 4) AS max, COUNT(*) FILTER (WHERE l_extendedprice IS NULL) AS null_count, CAST(0 AS BIGINT) AS invalid_numeric FROM lineitem""")
def column_profile(spark, sf):
    return rounded(s.profile(table(spark, sf, "lineitem"), [], "l_extendedprice").drop("complete"))


@query("column_profile_by_flag", """
SELECT l_returnflag, COUNT(l_quantity) AS count, ROUND(AVG(l_quantity), 6) AS mean, ROUND(STDDEV_SAMP(l_quantity), 6) AS std, MIN(l_quantity) AS min,
  QUANTILE_CONT(l_quantity, 0.01) AS p01, QUANTILE_CONT(l_quantity, 0.25) AS p25, QUANTILE_CONT(l_quantity, 0.5) AS p50, QUANTILE_CONT(l_quantity, 0.75) AS p75,
  QUANTILE_CONT(l_quantity, 0.99) AS p99, MAX(l_quantity) AS max FROM lineitem GROUP BY 1""")
def column_profile_by_flag(spark, sf):
    return rounded(s.profile(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity").drop("column", "complete", "null_count", "invalid_numeric"), 6)


@query("sum_squared_deviation", """
SELECT l_returnflag, ROUND(VAR_POP(l_quantity) * COUNT(l_quantity), 2) AS sum_squared_deviation FROM lineitem GROUP BY 1""")
def sum_squared_deviation(spark, sf):
    return rounded(s.sum_squared_deviation(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity"), 2)
