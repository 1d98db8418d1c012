"""Captured-figure checks. Each customer's order page is a component with four captures:

0 all orders, 1 pending orders switched off, 2 also a shorter date range, 3 everything put back
(for every seventh customer the revenue card keeps the filter).
"""

from pyspark.sql import functions as F

from checks.base import money, query, rounded, table
from plumbline.operators import observe as ob


def _figure(key, value, text):
    return F.struct(F.lit(key).alias("figure_key"), value.cast("double").alias("value"), text.alias("text"))


def _figures(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("component"), "o_orderstatus", F.to_date("o_orderdate").alias("d"), money("o_totalprice").alias("v"))
    open_ = F.col("o_orderstatus") != "P"
    early = open_ & (F.col("d") <= F.lit("1998-12-31").cast("date"))
    zero = F.lit(0).cast("decimal(28,4)")

    def total(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("v"))), zero)
    sums = orders.groupBy("component").agg(
        F.count(F.lit(1)).alias("n0"), F.count_if(open_).alias("n1"), F.count_if(early).alias("n2"), F.sum("v").alias("v0"), total(open_).alias("v1"), total(early).alias("v2"))
    stuck = F.when(F.col("component") % 7 == 0, F.col("v1")).otherwise(F.col("v0"))
    captures = F.array(*[F.struct(F.lit(i).alias("capture_ord"), n.alias("n"), v.cast("decimal(28,4)").alias("v")) for i, (n, v) in enumerate(
        [(F.col("n0"), F.col("v0")), (F.col("n1"), F.col("v1")), (F.col("n2"), F.col("v2")), (F.col("n0"), stuck)])])
    rows = sums.select("component", F.explode(captures).alias("c")).select("component", "c.*")
    n, v, none = F.col("n"), F.col("v").cast("double"), F.lit(None).cast("string")
    figures = F.array(
        _figure("card:orders", n, none), _figure("card:revenue", v, none),
        _figure("card:average", F.when(n.between(1, 12), v / n), F.when(n > 12, F.concat(F.lit("$"), n.cast("string"), F.lit("K")))),
        _figure("table:status", v + F.when(F.col("component") % 11 == 0, 1).otherwise(0), none))
    long = rows.select("component", "capture_ord", F.explode(figures).alias("f")).select("component", "capture_ord", "f.*")
    from plumbline.functions.scalars import format_number
    display = F.when(F.col("value").isNotNull(), format_number("value")).otherwise(F.coalesce("text", F.lit("")))
    name = F.concat("figure_key", F.lit(" "), F.floor(F.col("component") / 2).cast("string"))
    return long.withColumns({"display": display, "name": name})


def _captures(spark, sf):
    customers = table(spark, sf, "orders").select(F.col("o_custkey").alias("component")).distinct()
    k = F.col("capture_ord")
    rows = customers.select("component", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("capture_ord"))
    caption = F.when(k.isin(1, 2), "Multiple selections").otherwise("All")
    return rows.select(
        "component", "capture_ord", F.get(F.array(*[F.lit(x) for x in ("base", "no-pending", "narrow", "reset")]), k).alias("label"), F.lit("1995-01-01").cast("date").alias("date_start"),
        F.when(k == 2, F.lit("1998-12-31").cast("date")).otherwise(F.lit("2001-12-31").cast("date")).alias("date_end"), F.create_map(F.lit("Status"), caption).alias("slicers"))


def _steps(spark, sf):
    """The plan of each component; every fifth one forgets to switch the pending orders on again."""
    customers = table(spark, sf, "orders").select(F.col("o_custkey").alias("component")).distinct()

    def step(at, kind, member=None, selected=None, label=None):
        return F.struct(F.lit(at).alias("step_ord"), F.lit(kind).alias("kind"), F.lit("Status" if kind == "toggle_member" else None).cast("string").alias("control"),
                        F.lit(member).cast("string").alias("member"), F.lit(selected).cast("boolean").alias("selected"), F.lit(label).cast("string").alias("label"))
    plan = F.array(step(0, "capture", label="base"), step(1, "toggle_member", "P", False), step(2, "capture", label="no-pending"), step(3, "set_date"),
                   step(4, "capture", label="narrow"), step(5, "set_date"), step(6, "toggle_member", "P", True), step(7, "capture", label="reset"))
    rows = customers.select("component", F.explode(plan).alias("s")).select("component", "s.*")
    return rows.where(~((F.col("component") % 5 == 0) & (F.col("step_ord") == 6)))


def _actions(spark, sf):
    acts = ob.actions_between(_steps(spark, sf))
    return acts.groupBy("component", "capture_ord").agg(F.count(F.lit(1)).alias("actions"), F.min("kind").alias("kind"), F.min("selected").alias("selected"))


FIGS = """o AS (SELECT o_custkey AS c, COUNT(*) AS n0, SUM(v) AS v0, COUNT(*) FILTER (WHERE st <> 'P') AS n1, COALESCE(SUM(v) FILTER (WHERE st <> 'P'), 0) AS v1,
    COUNT(*) FILTER (WHERE st <> 'P' AND d <= DATE '1998-12-31') AS n2, COALESCE(SUM(v) FILTER (WHERE st <> 'P' AND d <= DATE '1998-12-31'), 0) AS v2
  FROM (SELECT o_custkey, o_orderstatus AS st, CAST(o_orderdate AS DATE) AS d, CAST(o_totalprice AS DECIMAL(18,4)) AS v FROM orders) GROUP BY 1),
caps AS (SELECT c, 0::BIGINT AS k, n0 AS n, v0 AS v FROM o UNION ALL SELECT c, 1, n1, v1 FROM o UNION ALL SELECT c, 2, n2, v2 FROM o
  UNION ALL SELECT c, 3, n0, CASE WHEN c % 7 = 0 THEN v1 ELSE v0 END FROM o),
figs0 AS (SELECT c, k, 'card:orders' AS f, CAST(n AS DOUBLE) AS value, NULL AS text FROM caps UNION ALL SELECT c, k, 'card:revenue', CAST(v AS DOUBLE), NULL FROM caps
  UNION ALL SELECT c, k, 'card:average', CASE WHEN n BETWEEN 1 AND 12 THEN CAST(v AS DOUBLE) / n END, CASE WHEN n > 12 THEN '$' || n || 'K' END FROM caps
  UNION ALL SELECT c, k, 'table:status', CAST(v AS DOUBLE) + CASE WHEN c % 11 = 0 THEN 1 ELSE 0 END, NULL FROM caps),
figs AS (SELECT *, COALESCE(CAST(ROUND(value, 2) AS VARCHAR), text, '') AS disp FROM figs0),
prev AS (SELECT a.c, a.k, a.f, a.value, b.value AS pv, a.disp, b.disp AS pd FROM figs a JOIN figs b ON a.c = b.c AND a.f = b.f AND b.k = a.k - 1),
base AS (SELECT a.c, a.k, a.f, a.value, b.value AS bv, a.disp, b.disp AS bd FROM figs a JOIN figs b ON a.c = b.c AND a.f = b.f AND b.k = 0)"""


@query("captured_figures", f"WITH {FIGS} SELECT c AS component, k AS capture_ord, f AS figure_key, ROUND(value, 7) AS value, text FROM figs")
def captured_figures(spark, sf):
    return rounded(_figures(spark, sf).select("component", "capture_ord", "figure_key", "value", "text"), 7)


@query("check_expectations", """
SELECT CAST(c AS VARCHAR) AS capture, 'card:orders' AS pointer, CASE WHEN c % 3 = 0 THEN 'failed' ELSE 'passed' END AS status, NULL AS error FROM (SELECT DISTINCT o_custkey AS c FROM orders)
UNION ALL SELECT CAST(c AS VARCHAR), 'card:absent', 'failed', 'Missing observation' FROM (SELECT DISTINCT o_custkey AS c FROM orders)
UNION ALL SELECT CAST(c AS VARCHAR), 'page', 'passed', NULL FROM (SELECT DISTINCT o_custkey AS c FROM orders)""")
def check_expectations(spark, sf):
    """An order count written as 5.0 instead of 5 does not match; a JSON object with reordered keys does."""
    counts = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c")).agg(F.count(F.lit(1)).cast("string").alias("n"))
    page = F.concat(F.lit('{"id": '), F.col("c").cast("string"), F.lit(', "open": [true, null]}'))
    observed = counts.select(F.col("c").cast("string").alias("capture"), F.explode(F.create_map(F.lit("card:orders"), F.col("n"), F.lit("page"), page)).alias("pointer", "value"))
    wanted = F.when(F.col("c") % 3 == 0, F.concat("n", F.lit(".0"))).otherwise(F.col("n"))
    turned = F.concat(F.lit('{"open": [true, null], "id": '), F.col("c").cast("string"), F.lit("}"))
    expected = counts.select(F.col("c").cast("string").alias("capture"), F.explode(F.create_map(F.lit("card:orders"), wanted, F.lit("card:absent"), F.col("n"), F.lit("page"), turned)).alias("pointer", "value"))
    return ob.check_expectations(observed, expected).select("capture", "pointer", "status", "error")


@query("resolve_expectations", """
WITH o AS (SELECT o_custkey AS c, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) / COUNT(*) AS v FROM orders GROUP BY 1)
SELECT c AS component, ROUND(CASE WHEN c % 4 = 0 THEN -1.0 WHEN c % 4 = 1 THEN ROUND_EVEN(v + 1e-9, 0) WHEN c % 4 = 2 THEN ROUND_EVEN(v * 100, 0) / 100 ELSE v END, 6) AS value FROM o""")
def resolve_expectations(spark, sf):
    rows = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("component")).agg((F.sum(money("o_totalprice")).cast("double") / F.count(F.lit(1))).alias("v"))
    oracles = rows.select(F.lit("average").alias("oracle"), F.col("component").alias("row"), F.lit("value").alias("column"), F.col("v").alias("value"))
    kind = F.col("component") % 4
    expected = rows.select("component", F.when(kind > 0, "average").alias("oracle"), F.col("component").alias("row"), F.lit("value").alias("column"),
                           F.when(kind == 1, 0).when(kind == 2, 2).alias("round"), F.when(kind == 0, -1.0).alias("value"))
    return rounded(ob.resolve_expectations(expected, oracles).select("component", "value"), 6)


@query("receipt_strength", f"""WITH {FIGS},
e AS (SELECT c, k, CASE WHEN k < 3 OR c % 2 = 1 THEN 1::BIGINT ELSE 0::BIGINT END AS asserted, n FROM caps),
p AS (SELECT a.*, COALESCE(a.asserted = 1 AND b.n = a.n, FALSE) AS same FROM e a LEFT JOIN e b ON a.c = b.c AND b.k = a.k - 1 AND b.asserted = 1),
q AS (SELECT c, k, asserted, CASE WHEN same THEN 1::BIGINT ELSE 0::BIGINT END AS identical, CASE WHEN k = 3 AND c % 10 = 0 THEN CASE WHEN c % 20 = 0 THEN NULL ELSE 'waiver without a reason' END
  WHEN asserted = 0 THEN 'asserts no value' WHEN k > 0 AND same THEN 'every asserted value is unchanged after an action' END AS problem FROM p)
SELECT c AS component, k AS capture_ord, asserted, identical, problem, CASE WHEN problem IS NULL THEN 'strong' ELSE 'weak' END AS strength FROM q""")
def receipt_strength(spark, sf):
    counts = _figures(spark, sf).where("figure_key = 'card:orders'").select("component", "capture_ord", F.col("value").cast("string").alias("value"))
    asserted = counts.where((F.col("capture_ord") < 3) | (F.col("component") % 2 == 1)).withColumn("pointer", F.lit("/cards/orders"))
    guards = counts.select("component", "capture_ord", F.lit("x").alias("value"), F.lit("/active_page").alias("pointer"))
    waived = (F.col("capture_ord") == 3) & (F.col("component") % 10 == 0)
    captures = counts.select("component", "capture_ord", F.when(F.col("capture_ord") > 0, 1).otherwise(0).cast("bigint").alias("actions"), waived.alias("allow_weak"),
                             F.when(F.col("component") % 20 == 0, "nothing on this page changes").alias("reason"))
    return rounded(ob.receipt_strength(asserted.unionByName(guards), captures))


PAIRS = """pairs AS (
  SELECT c, k, 'revenue twice' AS label, 'equality' AS form, r AS a, t AS b, 0.5 AS tol, NULL AS text, FALSE AS zero FROM w
  UNION ALL SELECT c, k, 'average order', 'ratio', CASE WHEN n <> 0 THEN r / n END, av, 0.01, txt, n = 0 FROM w
  UNION ALL SELECT c, k, 'revenue and orders', 'sum', r + n, t, 20, NULL, FALSE FROM w
  UNION ALL SELECT c, k, 'at least five', 'bound', n, 5, 0, NULL, FALSE FROM w),
w AS (SELECT c, k, MAX(value) FILTER (WHERE f = 'card:orders') AS n, MAX(value) FILTER (WHERE f = 'card:revenue') AS r, MAX(value) FILTER (WHERE f = 'card:average') AS av,
  MAX(text) FILTER (WHERE f = 'card:average') AS txt, MAX(value) FILTER (WHERE f = 'table:status') AS t FROM figs GROUP BY 1, 2),
res AS (SELECT *, CASE WHEN a IS NULL OR b IS NULL THEN 'not_comparable' WHEN form = 'bound' THEN CASE WHEN a >= b THEN 'consistent' ELSE 'inconsistent' END
  WHEN ABS(a - b) <= tol THEN 'consistent' ELSE 'inconsistent' END AS status,
  CASE WHEN a IS NULL OR b IS NULL THEN CASE WHEN zero THEN 'the figure it is divided by is zero' WHEN text IS NOT NULL THEN 'the card shows an abbreviated value; declare the exact figure through an oracle'
    ELSE 'one of the figures could not be read as a number' END END AS note FROM pairs)"""
_w = PAIRS[PAIRS.index("w AS (SELECT"):PAIRS.index("res AS (")]
RES = FIGS + ",\n" + _w + PAIRS[:PAIRS.index("w AS (SELECT")] + PAIRS[PAIRS.index("res AS ("):]


def _pairs(spark, sf):
    components = table(spark, sf, "orders").select(F.col("o_custkey").alias("component")).distinct()

    def pair(label, form, inputs, target=None, tolerance=0.0, minimum=None):
        return F.struct(F.lit(label).alias("label"), F.lit(form).alias("form"), F.array(*[F.lit(i) for i in inputs]).alias("inputs"), F.lit(target).cast("string").alias("target"),
                        F.lit(float(tolerance)).alias("tolerance"), F.lit(False).alias("percent"), F.lit(minimum).cast("double").alias("min"), F.lit(None).cast("double").alias("max"))
    declared = F.array(pair("revenue twice", "equality", ["card:revenue", "table:status"], None, 0.5), pair("average order", "ratio", ["card:revenue", "card:orders"], "card:average", 0.01),
                       pair("revenue and orders", "sum", ["card:revenue", "card:orders"], "table:status", 20), pair("at least five", "bound", ["card:orders"], None, 0, 5))
    return components.select("component", F.explode(declared).alias("p")).select("component", "p.*")


@query("consistency_pairs", f"""WITH {RES}
SELECT c AS component, k AS capture_ord, label, form, ROUND(a, 7) AS value_a, ROUND(CAST(b AS DOUBLE), 7) AS value_b, status, note FROM res""")
def consistency_pairs(spark, sf):
    return rounded(ob.evaluate_pairs(_figures(spark, sf), _pairs(spark, sf)), 7)


@query("consistency_equality", f"WITH {RES} SELECT c AS component, k AS capture_ord, status FROM res WHERE form = 'equality'")
def consistency_equality(spark, sf):
    return rounded(ob.consistency_equality(_figures(spark, sf), "card:revenue", "table:status", 0.5).select("component", "capture_ord", "status"))


@query("consistency_ratio", f"""WITH {RES} SELECT c AS component, k AS capture_ord, ROUND(a * 100, 4) AS value_a,
  CASE WHEN a IS NULL OR b IS NULL THEN 'not_comparable' WHEN ABS(a * 100 - b) <= 0.01 THEN 'consistent' ELSE 'inconsistent' END AS status FROM res WHERE form = 'ratio'""")
def consistency_ratio(spark, sf):
    """Read as a percentage the ratio no longer equals the card."""
    out = ob.consistency_ratio(_figures(spark, sf), "card:revenue", "card:orders", "card:average", 0.01, percent=True)
    return rounded(out.select("component", "capture_ord", "value_a", "status"))


@query("consistency_sum", f"WITH {RES} SELECT c AS component, k AS capture_ord, ROUND(a, 4) AS value_a, status FROM res WHERE form = 'sum'")
def consistency_sum(spark, sf):
    return rounded(ob.consistency_sum(_figures(spark, sf), ["card:revenue", "card:orders"], "table:status", 20).select("component", "capture_ord", "value_a", "status"))


@query("consistency_bound", f"WITH {RES} SELECT c AS component, k AS capture_ord, CASE WHEN a <= 12 THEN 'consistent' ELSE 'inconsistent' END AS status FROM res WHERE form = 'bound'")
def consistency_bound(spark, sf):
    return rounded(ob.consistency_bound(_figures(spark, sf), "card:orders", maximum=12).select("component", "capture_ord", "status"))


@query("consistency_status", f"WITH {RES} SELECT label, status, note, COUNT(*) AS captures FROM res GROUP BY 1, 2, 3")
def consistency_status(spark, sf):
    return ob.consistency_status(ob.evaluate_pairs(_figures(spark, sf), _pairs(spark, sf)))


@query("consistency_rollup", f"""WITH {RES}, g AS (SELECT c, label, COUNT(*) FILTER (WHERE status = 'inconsistent') AS failing, COUNT(*) FILTER (WHERE status = 'consistent') AS holding, MIN(note) AS note FROM res GROUP BY 1, 2)
SELECT c AS component, label, failing, holding, CASE WHEN failing = 0 AND holding = 0 THEN note END AS note, CASE WHEN failing > 0 THEN 'fail' WHEN holding > 0 THEN 'pass' ELSE 'unknown' END AS status FROM g""")
def consistency_rollup(spark, sf):
    return ob.consistency_rollup(ob.evaluate_pairs(_figures(spark, sf), _pairs(spark, sf)))


@query("receipt_rollup", """
SELECT o_custkey AS component, CASE WHEN COUNT(*) FILTER (WHERE o_orderstatus = 'P') = 0 THEN 'pass' ELSE 'fail' END AS status, COUNT(*) AS receipts FROM orders GROUP BY 1""")
def receipt_rollup(spark, sf):
    receipts = table(spark, sf, "orders").select(F.col("o_custkey").alias("component"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("passed").alias("status"))
    return ob.receipt_rollup(receipts)


@query("figure_delta", f"""WITH {FIGS}
SELECT c AS component, k AS capture_ord, f AS figure_key, ROUND(value - bv, 7) AS change, CAST(CASE WHEN bv <> 0 THEN ABS(ROUND_EVEN((value - bv) / bv * 100, 0)) END AS BIGINT) AS percent
FROM base WHERE k > 0 AND value <> bv""")
def figure_delta(spark, sf):
    return rounded(ob.delta(_figures(spark, sf)).select("component", "capture_ord", "figure_key", "change", "percent"), 7)


@query("changed_filters", """
SELECT c AS component, k::BIGINT AS capture_ord, CASE WHEN k = 0 THEN 'all values selected' WHEN k IN (1, 2) THEN 'Status: Multiple selections' ELSE 'as baseline' END AS changed_filters
FROM (SELECT DISTINCT o_custkey AS c FROM orders), (SELECT UNNEST([0, 1, 2, 3]) AS k)""")
def changed_filters(spark, sf):
    return rounded(ob.changed_filters(_captures(spark, sf)).drop("context"))


@query("restored_captures", """
SELECT c AS component, k::BIGINT AS capture_ord, label, CASE WHEN k = 0 THEN TRUE WHEN k = 3 THEN c % 5 <> 0 ELSE FALSE END AS restored
FROM (SELECT DISTINCT o_custkey AS c FROM orders), (SELECT UNNEST([0, 1, 2, 3]) AS k, UNNEST(['base', 'no-pending', 'narrow', 'reset']) AS label)""")
def restored_captures(spark, sf):
    return rounded(ob.restored_captures(_steps(spark, sf)))


@query("actions_between", """
SELECT c AS component, s::BIGINT AS step_ord, kind, k::BIGINT AS capture_ord, label AS capture_label
FROM (SELECT DISTINCT o_custkey AS c FROM orders), (SELECT UNNEST([1, 3, 5, 6]) AS s, UNNEST(['toggle_member', 'set_date', 'set_date', 'toggle_member']) AS kind, UNNEST([1, 2, 3, 3]) AS k, UNNEST(['no-pending', 'narrow', 'reset', 'reset']) AS label)
WHERE NOT (c % 5 = 0 AND s = 6)""")
def actions_between(spark, sf):
    return rounded(ob.actions_between(_steps(spark, sf)).select("component", "step_ord", "kind", "capture_ord", "capture_label"))


@query("reset_check", f"""WITH {FIGS}
SELECT c AS component, 3::BIGINT AS capture_ord, COUNT(*) FILTER (WHERE disp <> bd) AS differing, CASE WHEN COUNT(*) FILTER (WHERE disp <> bd) > 0 THEN 'fail' ELSE 'pass' END AS status
FROM base WHERE k = 3 AND c % 5 <> 0 GROUP BY 1""")
def reset_check(spark, sf):
    return rounded(ob.reset_check(_captures(spark, sf), _figures(spark, sf), ob.restored_captures(_steps(spark, sf))))


@query("changed_check", f"""WITH {FIGS}
SELECT c AS component, k AS capture_ord, CAST(CASE WHEN k = 3 AND c % 5 <> 0 THEN 2 ELSE 1 END AS BIGINT) AS actions, COUNT(*) FILTER (WHERE disp <> pd) AS moved,
  CASE WHEN COUNT(*) FILTER (WHERE disp <> pd) > 0 THEN 'pass' ELSE 'fail' END AS status FROM prev GROUP BY 1, 2""")
def changed_check(spark, sf):
    return rounded(ob.changed_check(_figures(spark, sf), _actions(spark, sf)))


@query("direction_check", f"""WITH {FIGS},
d AS (SELECT c, k, CASE WHEN k IN (1, 2) THEN 'not_up' WHEN c % 5 = 0 THEN 'not_down' END AS expectation, value, pv FROM prev),
g AS (SELECT c, k, expectation, COUNT(*) FILTER (WHERE CASE WHEN expectation = 'not_up' THEN value > pv ELSE value < pv END) AS wrong FROM d WHERE expectation IS NOT NULL GROUP BY 1, 2, 3)
SELECT c AS component, k AS capture_ord, expectation, wrong, CASE WHEN wrong > 0 THEN 'fail' ELSE 'pass' END AS status FROM g""")
def direction_check(spark, sf):
    return rounded(ob.direction_check(_figures(spark, sf), _captures(spark, sf), _actions(spark, sf)))


@query("cross_component", f"""WITH {FIGS},
x AS (SELECT f || ' ' || (c // 2) AS name, CASE WHEN k IN (0, 3) THEN 0 ELSE k END AS ctx, c, ARG_MIN(disp, k) AS disp FROM figs GROUP BY 1, 2, 3)
SELECT name, ctx::BIGINT AS ctx, COUNT(*) AS components, CASE WHEN MIN(disp) = MAX(disp) THEN 'pass' ELSE 'fail' END AS status FROM x GROUP BY 1, 2 HAVING COUNT(*) >= 2""")
def cross_component(spark, sf):
    out = ob.cross_component(_figures(spark, sf), _captures(spark, sf))
    ctx = F.when(F.contains("context", F.lit("1998-12-31")), 2).when(F.contains("context", F.lit("Multiple")), 1).otherwise(0).cast("bigint")
    return out.select("name", ctx.alias("ctx"), "components", "status")


@query("shared_without_match", f"""WITH {FIGS},
x AS (SELECT f || ' ' || (c // 2) AS name, c, CASE WHEN k IN (0, 3) THEN 0 ELSE k END AS ctx, MIN(k) AS k FROM figs GROUP BY 1, 2, 3),
m AS (SELECT name FROM x GROUP BY 1 HAVING COUNT(DISTINCT c) >= 2)
SELECT name, ROW_NUMBER() OVER (PARTITION BY name ORDER BY c, k) AS position, c AS component, k AS capture_ord FROM x WHERE name IN (SELECT name FROM m) QUALIFY position <= 12""")
def shared_without_match(spark, sf):
    own = _captures(spark, sf).withColumn("slicers", F.map_concat("slicers", F.create_map(F.lit("Customer"), F.col("component").cast("string"))))
    return rounded(ob.shared_without_match(_figures(spark, sf), own).select("name", "position", "component", "capture_ord"))


@query("observed_table", f"""WITH {FIGS},
w AS (SELECT c, k, MAX(value) FILTER (WHERE f = 'card:orders') AS n, MAX(value) FILTER (WHERE f = 'card:revenue') AS r, MAX(value - bv) FILTER (WHERE f = 'card:orders') AS dn,
  MAX(value - bv) FILTER (WHERE f = 'card:revenue') AS dr, COUNT(*) FILTER (WHERE disp <> bd) AS differing FROM base GROUP BY 1, 2)
SELECT c AS component, k AS capture_ord, CASE WHEN k = 0 THEN 'all values selected' WHEN k IN (1, 2) THEN 'Status: Multiple selections' ELSE 'as baseline' END AS changed_filters, n AS orders, ROUND(r, 4) AS revenue,
  CASE WHEN k > 0 THEN dn END AS orders_change, CASE WHEN k > 0 THEN ROUND(dr, 4) END AS revenue_change,
  CASE WHEN k = 3 AND c % 5 <> 0 THEN CASE WHEN differing > 0 THEN 'Differs from baseline' ELSE 'Back to baseline' END END AS back_to_baseline FROM w""")
def observed_table(spark, sf):
    out = ob.observed_table(_captures(spark, sf), _figures(spark, sf), ["card:orders", "card:revenue"], ob.restored_captures(_steps(spark, sf)))
    return rounded(out.select("component", "capture_ord", "changed_filters", F.col("`card:orders_value`").alias("orders"), F.col("`card:revenue_value`").alias("revenue"),
                              F.col("`card:orders_change`").alias("orders_change"), F.col("`card:revenue_change`").alias("revenue_change"), "back_to_baseline"))
