"""Invariant probes on orders, line items, events and dimensions."""

import datetime as dt

from pyspark.sql import functions as F

from checks.base import money, query, rounded, table
from plumbline.operators import invariants as inv
from plumbline.operators import time_joins


def _orders_window(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("start_date"), F.date_add(F.to_date("o_orderdate"), 90).alias("end_date"))


WINDOW = """w AS (SELECT l_orderkey, CAST(l_shipdate AS DATE) AS day, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + 90 AS e, l_linestatus
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey)"""


@query("assert_value", """
SELECT CASE WHEN n <= 0 THEN 'passed' ELSE 'failed' END AS status, CAST(n AS DOUBLE) AS actual, '<=' AS operator, CAST(0 AS DOUBLE) AS expected
FROM (SELECT COUNT(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate)""")
def assert_value(spark, sf):
    """No line item may ship before its order."""
    items = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    bad = items.agg(F.count_if(F.col("l_shipdate") < F.col("o_orderdate")).alias("bad"))
    return rounded(inv.assert_value(bad, "bad", "<=", 0).select("status", "actual", "operator", "expected"))


@query("assert_value_row", """
SELECT CASE WHEN ABS(n - 12000) <= 500 THEN 'passed' ELSE 'failed' END AS status, CAST(n AS DOUBLE) AS actual FROM (
  SELECT COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus LIMIT 1 OFFSET 1)""")
def assert_value_row(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    return rounded(inv.assert_value(counts, "n", "==", 12000, tolerance=500, row=1, order=["l_returnflag", "l_linestatus"]).select("status", "actual"))


@query("window_alignment", f"""WITH {WINDOW}
SELECT l_linestatus, COUNT(*) AS outside, MIN(CAST(day AS VARCHAR)) AS first_day FROM w WHERE s IS NOT NULL AND (day < s OR day > e) GROUP BY 1""")
def window_alignment(spark, sf):
    out = inv.window_alignment(table(spark, sf, "lineitem"), _orders_window(spark, sf), "l_orderkey", "o_orderkey", "l_shipdate", "start_date", "end_date")
    return rounded(out.groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("outside"), F.min(F.to_date("l_shipdate")).alias("first_day")))


@query("undated_events", """
SELECT e.event_type, COUNT(*) AS undated FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey AND c.c_acctbal >= 0
WHERE e.user_id IS NOT NULL AND c.c_custkey IS NULL GROUP BY 1""")
def undated_events(spark, sf):
    """Events of users without a start date: customers in debt carry none."""
    dim = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.lit(dt.date(2024, 1, 1))).alias("start_date"))
    return inv.undated_events(table(spark, sf, "events"), dim, "user_id", "c_custkey", "start_date").groupBy("event_type").agg(F.count(F.lit(1)).alias("undated"))


@query("name_churn", """
SELECT l_partkey, COUNT(DISTINCT l_linestatus || l_returnflag) AS names, COUNT(*) AS rows FROM lineitem GROUP BY 1 HAVING COUNT(DISTINCT l_linestatus || l_returnflag) > 1""")
def name_churn(spark, sf):
    items = table(spark, sf, "lineitem").withColumn("name", F.concat("l_linestatus", "l_returnflag"))
    return inv.name_churn(items, "l_partkey", "name")


@query("member_set_diff", """
SELECT COALESCE(a.k, b.k) AS member, a.k IS NOT NULL AS in_a, b.k IS NOT NULL AS in_b
FROM (SELECT DISTINCT o_custkey AS k FROM orders) a FULL JOIN (SELECT c_custkey AS k FROM customer) b ON a.k = b.k""")
def member_set_diff(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    b = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    return inv.member_set_diff(a, b, "k")


@query("day_boundary", """
SELECT event_type, COUNT(*) FILTER (WHERE CAST(ts - INTERVAL 5 HOUR AS DATE) <> CAST(ts AS DATE)) AS mismatched, COUNT(*) AS rows FROM events GROUP BY 1""")
def day_boundary(spark, sf):
    events = table(spark, sf, "events").withColumn("date_key", F.to_date("ts"))
    return inv.day_boundary(events, "ts", "date_key", offset_hours=-5, by=["event_type"])


@query("day_boundary_zone", """
SELECT event_type, COUNT(*) FILTER (WHERE CAST(ts - INTERVAL 5 HOUR AS DATE) <> CAST(ts AS DATE)) AS mismatched, COUNT(*) AS rows FROM events GROUP BY 1""")
def day_boundary_zone(spark, sf):
    """January in Toronto is five hours behind UTC."""
    events = table(spark, sf, "events").withColumn("date_key", F.to_date("ts"))
    return inv.day_boundary(events, "ts", "date_key", tz="America/Toronto", by=["event_type"])


@query("negative_durations", """
SELECT l_linestatus, COUNT(*) FILTER (WHERE l_shipdate < o_orderdate) AS negative, COUNT(*) AS rows FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def negative_durations(spark, sf):
    items = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return inv.negative_durations(items, F.date_diff("l_shipdate", "o_orderdate"), by=["l_linestatus"])


@query("after_watermark", """
SELECT l_linestatus, COUNT(*) FILTER (WHERE CAST(l_shipdate AS DATE) > (SELECT CAST(MAX(o_orderdate) AS DATE) FROM orders)) AS after_watermark, COUNT(*) AS rows FROM lineitem GROUP BY 1""")
def after_watermark(spark, sf):
    loaded = table(spark, sf, "orders").select("o_orderdate")
    return inv.after_watermark(table(spark, sf, "lineitem"), "l_shipdate", loaded, by=["l_linestatus"])


@query("orphan_keys", """
SELECT CASE WHEN b.n IS NULL THEN 'fact_without_dim' ELSE 'dim_without_fact' END AS side, COALESCE(a.k, b.k) AS key,
  COALESCE(a.n, 0) AS fact_rows, COALESCE(b.n, 0) AS dim_rows
FROM (SELECT l_orderkey AS k, COUNT(*) AS n FROM lineitem GROUP BY 1) a FULL JOIN (SELECT o_orderkey AS k, COUNT(*) AS n FROM orders GROUP BY 1) b ON a.k = b.k
WHERE a.n IS NULL OR b.n IS NULL""")
def orphan_keys(spark, sf):
    return inv.orphan_keys(table(spark, sf, "lineitem"), table(spark, sf, "orders"), "l_orderkey", "o_orderkey")


@query("zero_denominator", """
SELECT p_partkey, CASE WHEN n IS NULL THEN 'absent' WHEN d IS NULL THEN 'null' ELSE 'zero' END AS state, COALESCE(n, 0) AS rows
FROM part LEFT JOIN (SELECT l_partkey, COUNT(*) AS n, SUM(l_discount) AS d FROM lineitem GROUP BY 1) ON p_partkey = l_partkey
WHERE n IS NULL OR d IS NULL OR d = 0""")
def zero_denominator(spark, sf):
    items = table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    return inv.zero_denominator(items, ["p_partkey"], "l_discount", table(spark, sf, "part"))


@query("flagged_complete_periods", """
WITH d AS (SELECT DATE_TRUNC('month', CAST(o_orderdate AS DATE)) AS m, MAX(CAST(o_orderdate AS DATE)) AS last FROM orders GROUP BY 1),
f AS (SELECT DISTINCT DATE_TRUNC('month', CAST(l_shipdate AS DATE)) AS m FROM lineitem)
SELECT CAST(CAST(f.m AS DATE) AS VARCHAR) AS month, CAST(LAST_DAY(f.m) AS VARCHAR) AS last_day, CAST(last AS VARCHAR) AS last_data
FROM f LEFT JOIN d ON f.m = d.m WHERE last IS NULL OR last < LAST_DAY(f.m)""")
def flagged_complete_periods(spark, sf):
    """Every month with a shipment is marked complete; order data must reach its last day."""
    calendar = table(spark, sf, "lineitem").select(F.trunc("l_shipdate", "month").alias("month"), F.lit(True).alias("complete")).distinct()
    return rounded(inv.flagged_complete_periods(calendar, table(spark, sf, "orders"), "month", "complete", "o_orderdate"))


@query("empty_days", """
SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS day FROM (SELECT UNNEST(GENERATE_SERIES(MIN(CAST(o_orderdate AS DATE)), MAX(CAST(o_orderdate AS DATE)), INTERVAL 1 DAY)) AS d FROM orders)
WHERE CAST(d AS DATE) NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders)""")
def empty_days(spark, sf):
    return rounded(inv.empty_days(table(spark, sf, "orders"), "o_orderdate"))


@query("partial_period_share", """
WITH x AS (SELECT o_orderpriority, SUM(CASE WHEN CAST(o_orderdate AS DATE) <= DATE '1998-07-13' THEN CAST(o_totalprice AS DECIMAL(18,4)) END) AS p,
  SUM(CAST(o_totalprice AS DECIMAL(18,4))) AS w FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1998-07-01' AND DATE '1998-07-31' GROUP BY 1)
SELECT o_orderpriority, ROUND(CAST(COALESCE(p, 0) AS DOUBLE), 2) AS partial_amount, ROUND(CAST(w AS DOUBLE), 2) AS whole_amount,
  ROUND(CAST(COALESCE(p, 0) AS DOUBLE) / CAST(w AS DOUBLE), 2) AS share, ROUND(CAST(w AS DOUBLE), 2) AS reported, 'whole' AS shows FROM x""")
def partial_period_share(spark, sf):
    """A report that shows the whole month under a selection of its first 13 days."""
    orders = table(spark, sf, "orders").withColumn("amount", money("o_totalprice"))
    july = orders.where(F.to_date("o_orderdate").between(F.lit("1998-07-01").cast("date"), F.lit("1998-07-31").cast("date")))
    reported = july.groupBy("o_orderpriority").agg(F.sum("amount").alias("reported"))
    return rounded(inv.partial_period_share(orders, ["o_orderpriority"], "o_orderdate", "amount", "1998-07-01", "1998-07-13", "1998-07-01", "1998-07-31", reported), 2)


@query("latest_version", """
SELECT user_id, event_id, event_type, ROUND(value, 4) AS value FROM (
  SELECT * FROM events WHERE ts <= TIMESTAMP '2024-01-20 00:00:00' QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
WHERE event_type <> 'error'""")
def latest_version(spark, sf):
    """Newest event per user at a bound; errors are left out only after the newest event is chosen."""
    newest = inv.latest_version(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"),
                                eligible=F.col("event_type") != "error")
    return rounded(newest.select("user_id", "event_id", "event_type", "value"))


#: A third of the facts and of the versions share key 0.
VERSIONS = """f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate AS t, CASE WHEN l_orderkey % 3 = 0 THEN 0 WHEN l_orderkey % 101 = 0 THEN NULL ELSE l_suppkey END AS k FROM lineitem),
v AS (SELECT o_orderkey, o_orderdate AS t, o_orderpriority, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey % 100 END AS k FROM orders)"""


def _facts_and_versions(spark, sf):
    key = F.when(F.col("l_orderkey") % 3 == 0, 0).when(F.col("l_orderkey") % 101 == 0, None).otherwise(F.col("l_suppkey"))
    facts = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_shipdate").alias("at"), key.cast("bigint").alias("k"))
    own = F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(F.col("o_custkey") % 100)
    versions = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("at"), "o_orderpriority", own.cast("bigint").alias("k"))
    return facts, versions


@query("version_in_force", f"""WITH {VERSIONS}, one AS (SELECT * FROM v QUALIFY ROW_NUMBER() OVER (PARTITION BY k, t ORDER BY o_orderkey DESC) = 1)
SELECT l_orderkey, l_linenumber, l_partkey, one.o_orderkey AS version_o_orderkey, CAST(one.t AS VARCHAR) AS version_at FROM f ASOF LEFT JOIN one ON f.k = one.k AND f.t >= one.t""")
def version_in_force(spark, sf):
    """Every line with the last order of its key at or before its shipping date."""
    facts, versions = _facts_and_versions(spark, sf)
    out = time_joins.as_of_join(facts, versions, ["k"], "at", "at", ["o_orderkey"])
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "version_o_orderkey", "version_at"))


@query("eligible_version_in_force", f"""WITH {VERSIONS}, one AS (SELECT * FROM v QUALIFY ROW_NUMBER() OVER (PARTITION BY k, t ORDER BY o_orderkey DESC) = 1),
j AS (SELECT f.k, one.o_orderkey AS o, one.o_orderpriority AS p FROM f ASOF LEFT JOIN one ON f.k = one.k AND f.t >= one.t)
SELECT k, CASE WHEN p <> '1-URGENT' THEN p END AS priority, COUNT(*) AS lines FROM j GROUP BY 1, 2""")
def eligible_version_in_force(spark, sf):
    """Lines per key and priority of the version in force; an urgent version is no version, and does not give way to an older one."""
    facts, versions = _facts_and_versions(spark, sf)
    out = time_joins.as_of_join(facts, versions, ["k"], "at", "at", ["o_orderkey"], eligible=F.col("o_orderpriority") != "1-URGENT")
    return out.groupBy("k", F.col("version_o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("lines"))


COVER = f"""{VERSIONS}, w AS (SELECT k, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(t AS DATE) END AS s, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(t AS DATE) + CAST(o_orderkey % 40 - 3 AS INTEGER) END AS e FROM v),
d AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(t AS DATE) AS day, k, ROW_NUMBER() OVER () AS r FROM f)"""


def _covered(spark, sf):
    facts, versions = _facts_and_versions(spark, sf)
    day, o = F.to_date("at"), F.col("o_orderkey")
    windows = versions.select("k", F.when(o % 17 != 0, day).alias("s"), F.when(o % 13 != 0, F.date_add(day, (o % 40 - 3).cast("int"))).alias("e"))
    return facts.withColumn("day", day).drop("at"), windows


@query("window_coverage", f"""WITH {COVER}, n AS (SELECT k, COUNT(*) AS windows FROM w WHERE s IS NOT NULL GROUP BY 1),
g AS (SELECT k, day, COUNT(s) AS covering FROM (SELECT DISTINCT k, day FROM d) q LEFT JOIN w USING (k) WHERE s <= day AND (e IS NULL OR day <= e) GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN d.k IS NOT NULL THEN COALESCE(windows, 0) END AS windows, CASE WHEN d.k IS NOT NULL THEN COALESCE(covering, 0) END AS covering
FROM d LEFT JOIN n USING (k) LEFT JOIN g ON g.k = d.k AND g.day = d.day""")
def window_coverage(spark, sf):
    """How many of the overlapping windows of its key contain each line's day."""
    facts, windows = _covered(spark, sf)
    return time_joins.window_coverage(facts, windows, "k", "k", "day", "s", "e").select("l_orderkey", "l_linenumber", "l_partkey", "windows", "covering")


@query("outside_all_windows", f"""WITH {COVER}, n AS (SELECT DISTINCT k FROM w WHERE s IS NOT NULL), g AS (SELECT DISTINCT q.k, day FROM (SELECT DISTINCT k, day FROM d) q JOIN w ON w.k = q.k AND s <= day AND day <= e)
SELECT d.k, COUNT(*) AS outside FROM d JOIN n USING (k) LEFT JOIN g ON g.k = d.k AND g.day = d.day WHERE g.k IS NULL GROUP BY 1""")
def outside_all_windows(spark, sf):
    """Lines per key that no window contains; a window without an end contains nothing here."""
    facts, windows = _covered(spark, sf)
    out = time_joins.outside_all_windows(facts, windows, "k", "k", "day", "s", "e", open_end="outside")
    return out.groupBy("k").agg(F.count(F.lit(1)).alias("outside"))


@query("grain_check", """
SELECT SUM(n)::BIGINT AS rows, COUNT(*) AS distinct_keys, COUNT(*) FILTER (WHERE n > 1) AS repeated_keys, MAX(n) AS worst, (SUM(n) - COUNT(*))::BIGINT AS duplicate_rows,
  CASE WHEN SUM(n) > COUNT(*) THEN 'flagged' ELSE 'clean' END AS status FROM (SELECT COUNT(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""")
def grain_check(spark, sf):
    return inv.grain_check(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("join_amount_check", """
WITH j AS (SELECT CAST(COUNT(*) AS DOUBLE) AS n, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS v FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey),
b AS (SELECT CAST(COUNT(*) AS DOUBLE) AS n, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS v FROM orders)
SELECT 'rows' AS measure, b.n AS before, j.n AS after, j.n - b.n AS delta, CASE WHEN j.n = b.n THEN 'clean' ELSE 'flagged' END AS status FROM b, j
UNION ALL SELECT 'amount', ROUND(b.v, 2), ROUND(j.v, 2), ROUND(j.v - b.v, 2), CASE WHEN j.v = b.v THEN 'clean' ELSE 'flagged' END FROM b, j""")
def join_amount_check(spark, sf):
    orders = table(spark, sf, "orders").withColumn("amount", money("o_totalprice"))
    return rounded(inv.join_amount_check(orders, table(spark, sf, "lineitem"), ["o_orderkey"], ["l_orderkey"], ["amount"]), 2)


@query("overlap_check", """
WITH t AS (SELECT l_linestatus, COUNT(DISTINCT l_suppkey) AS total FROM lineitem GROUP BY 1),
s AS (SELECT l_linestatus, SUM(n)::BIGINT AS seg FROM (SELECT l_linestatus, l_returnflag, COUNT(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1),
k AS (SELECT l_linestatus, COUNT(*) AS shared FROM (SELECT l_linestatus, l_suppkey FROM lineitem GROUP BY 1, 2 HAVING COUNT(DISTINCT l_returnflag) > 1) GROUP BY 1)
SELECT l_linestatus, total AS distinct_total, seg AS segment_sum, COALESCE(shared, 0) AS shared_keys, seg - total AS overlap FROM t JOIN s USING (l_linestatus) LEFT JOIN k USING (l_linestatus)""")
def overlap_check(spark, sf):
    return inv.overlap_check(table(spark, sf, "lineitem"), "l_suppkey", "l_returnflag", ["l_linestatus"])


@query("segment_reconcile", """
WITH a AS (SELECT c_mktsegment AS s, COUNT(*) AS n, SUM(CAST(o_totalprice AS DECIMAL(18,4))) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
b AS (SELECT c_mktsegment AS s, COUNT(*) AS n, SUM(CAST(o_totalprice AS DECIMAL(18,4))) AS v FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' GROUP BY 1)
SELECT s AS c_mktsegment, a.n AS source_rows, COALESCE(b.n, 0) AS model_rows, ROUND(CAST(a.v AS DOUBLE), 2) AS source_amount, ROUND(CAST(COALESCE(b.v, 0) AS DOUBLE), 2) AS model_amount,
  COALESCE(b.n, 0) - a.n AS row_delta, ROUND(CAST(COALESCE(b.v, 0) AS DOUBLE) - CAST(a.v AS DOUBLE), 2) AS amount_delta, CASE WHEN COALESCE(b.n, 0) = a.n THEN 'equal' ELSE 'different' END AS status
FROM a LEFT JOIN b USING (s)""")
def segment_reconcile(spark, sf):
    """Orders by customer segment against a model that lost the pending ones."""
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("amount", money("o_totalprice"))
    return rounded(inv.segment_reconcile(orders, orders.where("o_orderstatus != 'P'"), ["c_mktsegment"], "amount"), 2)


@query("top_offenders", """
WITH v AS (SELECT l_suppkey, COUNT(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate GROUP BY 1)
SELECT l_suppkey, n AS violations, ROUND(n / (SELECT SUM(n) FROM v), 8) AS share, ROUND(n / CAST((SELECT COUNT(*) FROM lineitem) AS DOUBLE), 8) AS population_share
FROM v ORDER BY n DESC, l_suppkey LIMIT 10""")
def top_offenders(spark, sf):
    items = table(spark, sf, "lineitem")
    bad = items.join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate < o_orderdate")
    return rounded(inv.top_offenders(bad, ["l_suppkey"], 10, items), 8)


@query("subtotal_shape", """
SELECT o_orderpriority, o_orderstatus, CAST(GROUPING_ID(o_orderpriority, o_orderstatus) AS BIGINT) AS grain, COUNT(*) AS rows, ROUND(CAST(SUM(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE), 2) AS amount
FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)""")
def subtotal_shape(spark, sf):
    orders = table(spark, sf, "orders").withColumn("value", money("o_totalprice"))
    return rounded(inv.subtotal_shape(orders, ["o_orderpriority", "o_orderstatus"], "value"), 2)


@query("subtotal_cube", """
SELECT l_returnflag, l_linestatus, CAST(GROUPING_ID(l_returnflag, l_linestatus) AS BIGINT) AS grain, COUNT(*) AS rows, ROUND(SUM(l_quantity), 2) AS amount
FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def subtotal_cube(spark, sf):
    return rounded(inv.subtotal_shape(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "cube"), 2)
